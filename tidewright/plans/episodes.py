"""Queries on tool-call behaviour, matching, events and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.operators import episodes as E
from tidewright.operators import joins, metrics, selection, worlds
from tidewright.sources import tables as T

CALLS = """calls AS (SELECT user_id AS episode_id, event_id AS seq, event_type AS name, props AS arguments, event_type = 'error' AS failed, event_type = 'purchase' AS write, ts, value FROM events)"""
MESSAGES = """messages AS (SELECT conv_id AS episode_id, turn, role, coalesce(text, '') AS content FROM conversations)"""


def repeat_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per episode: calls, failures, repeats of the call that failed just before (same tool), and their rate."""
    rows = E.repeated_failures(T.calls(spark, sf_dir).withColumn("arguments", F.lit("{}")))
    return rows.groupBy("episode_id").agg(
        F.count("*").alias("calls"), F.count(F.when(F.col("failed"), 1)).alias("failures"), F.count(F.when(F.col("repeats"), 1)).alias("repeats"), F.round(F.avg(F.col("repeats").cast("int")), 6).alias("rate")
    )


def redundant_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per episode: turns, and turns that only repeat calls made since the last successful write."""
    rows = E.redundant_turns(T.calls(spark, sf_dir))
    return rows.groupBy("episode_id").agg(F.count("*").alias("turns"), F.count(F.when(F.col("redundant"), 1)).alias("redundant"))


def rolling_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the error rate of a user's last 40 events passes a quarter."""
    rows = E.rolling_breaker(T.calls(spark, sf_dir), ["ts", "msg_idx"], "failed", by=["episode_id"])
    return rows.select("episode_id", F.col("msg_idx").alias("seq"), F.round("rate", 6).alias("rate"), "tripped")


def failure_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed calls that agree in user and arguments."""
    rows = T.calls(spark, sf_dir).where("failed").withColumn("arguments", S.canonical_map(F.from_json("arguments", "map<string,string>")))
    out = joins.failure_clusters(rows, ["episode_id", "arguments"], "msg_idx")
    return out.select("episode_id", F.get_json_object("arguments", "$.k").cast("long").alias("k"), "episodes", "first")


def flags_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conversations carry each flag on their replies."""
    flags = E.reply_flags(T.messages(spark, sf_dir))
    named = E.flag_names(flags, ["announce", "language", "leak", "repeat", "report"])
    n = named.agg(F.count("*").alias("episodes"))
    counts = named.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(n)).select("flag", "n", F.round(F.col("n") / F.col("episodes"), 6).alias("rate"))


def result_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a purchase's argument occurred in an earlier view of the same user."""
    c = T.calls(spark, sf_dir)
    side = F.when(F.col("name") == "view", "result").when(F.col("name") == "purchase", "argument")
    values = c.withColumn("side", side).where("side is not null").select("episode_id", F.col("msg_idx").alias("seq"), "side", F.col("arguments").alias("value"))
    return joins.result_dependency(values)


def gold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events of the first half of the month as wanted calls, matched to all events after them."""
    c = T.calls(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("episode_id").orderBy("ts", "msg_idx")))
    args = F.from_json("arguments", "map<string,string>").alias("args")
    gold = c.where("ts < '2024-01-16'").select("episode_id", F.col("k").alias("gold_idx"), "name", args)
    made = c.where("ts >= '2024-01-16'").select("episode_id", F.col("k").alias("call_idx"), "name", args)
    out = joins.gold_match(gold, made)
    return out.select("episode_id", "gold_idx", "name", "kind", F.coalesce("call_idx", F.lit(-1)).alias("call_idx"), F.size("differing").alias("differing"))


def scheduled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's cells (event type to value) when all events of the first ten days are due."""
    ev = T.calls(spark, sf_dir)
    changes = ev.select(F.col("msg_idx").alias("event_id"), F.col("ts").alias("at"), F.lit("users").alias("table"), F.col("episode_id").alias("row_id"), F.create_map("name", F.col("value").cast("string")).alias("set"))
    rows = ev.select(F.lit("users").alias("table"), F.col("episode_id").alias("row_id")).distinct().withColumn("cells", F.create_map(F.lit("click"), F.lit("0.0")))
    out = worlds.apply_events(rows, changes, F.lit("2024-01-11 00:00:00").cast("timestamp"))
    return out.select("row_id", F.explode("cells").alias("column", "value")).select("row_id", "column", F.round(F.col("value").cast("double"), 6).alias("value"))


def contiguous_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's acknowledged days run without a gap from the first of January."""
    acks = T.calls(spark, sf_dir).select("episode_id", F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("day"))
    return selection.contiguous_prefix(acks, "episode_id", "day")


def learning_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a metric journal: purchases are rollouts, errors quarantines, signups optimizer steps, views skips."""
    c = T.calls(spark, sf_dir)
    k = F.get_json_object("arguments", "$.k").cast("int")
    kind = F.when(F.col("name") == "purchase", "rollout_received").when(F.col("name") == "error", "environment_quarantined").when(F.col("name") == "signup", "optimizer_step").otherwise("skip")
    records = c.select(
        kind.alias("event"), F.col("episode_id").alias("task_id"), k.alias("dataset_index"), F.lit(None).cast("int").alias("attempt"), F.col("msg_idx").alias("arrival"),
        (k % 2 == 0).alias("eligible"), (k % 4 == 0).alias("zero_advantage"), (k % 5 == 0).alias("all_success"), (k % 9).cast("long").alias("successes"),
        F.when(k % 10 != 0, F.lit(8)).cast("long").alias("episodes"), F.when(F.col("name") == "view", "age").alias("skipped"), F.when(k % 3 == 0, k).alias("mini_batch"),
    )
    out = metrics.learning_signals(records)
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"}).withColumn("task_id", F.coalesce("task_id", F.lit(-1).cast("long")))


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clerk-like priority: finished orders whose ten days meet a pending order of the same customer."""
    o = T.episodes(spark, sf_dir).select("group_id", "episode_id", "terminated", F.col("arrival").cast("timestamp").cast("long").alias("start"))
    spans = o.withColumn("end", F.col("start") + 10 * 86_400)
    out = joins.overlapping(spans.where("terminated"), spans.where("not terminated"), ["group_id"], width=30 * 86_400)
    return out.select("group_id", "episode_id")


def signature_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations per signature (their last assistant words), where several share one."""
    m = T.messages(spark, sf_dir)
    none = m.select("episode_id", "msg_idx", F.lit(0).alias("call_idx"), F.lit("").alias("name")).where("false")
    return E.signature(m, none).select("episode_id", F.substring_index("key", "\n", -1).alias("words")).groupBy("words").agg(F.count("*").alias("episodes"), F.min("episode_id").alias("first"))


def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prefix per assistant turn: its length in messages and in characters."""
    held = T.messages(spark, sf_dir).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "role", "content"))).alias("messages"))
    out = E.training_examples(held)
    total = F.aggregate("messages", F.lit(0).cast("long"), lambda s, m: s + F.length(m["content"]))
    return out.select("episode_id", "turn", F.size("messages").alias("messages"), total.alias("characters"))


def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotions of users through levels: two groups of ten events in a row with a success rate of 0.75 or more."""
    from tidewright.streaming.curriculum import promote

    c = T.calls(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("episode_id").orderBy("ts", "msg_idx")) - 1)
    groups = c.groupBy("episode_id", F.floor(F.col("k") / 10).alias("arrival")).agg(F.avg((~F.col("failed")).cast("int")).alias("rate"))
    out = promote(groups.select(F.col("episode_id").alias("task_id"), "arrival", "rate"), levels=4, threshold=0.75)
    return out


QUERIES = {
    "repeat_failures": (
        repeat_failures,
        f"""WITH {CALLS}, r AS (SELECT *, coalesce(lag(name) OVER w = name AND lag(failed) OVER w, false) AS rep FROM calls WINDOW w AS (PARTITION BY episode_id ORDER BY seq))
SELECT episode_id, count(*) AS calls, count(*) FILTER (WHERE failed) AS failures, count(*) FILTER (WHERE rep) AS repeats, round(avg(rep::INT), 6) AS rate FROM r GROUP BY episode_id""",
    ),
    "redundant_calls": (
        redundant_calls,
        f"""WITH {CALLS}, e AS (SELECT *, coalesce(sum((write AND NOT failed)::INT) OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ep FROM calls),
s AS (SELECT episode_id, min(seq) OVER (PARTITION BY episode_id, ep, name, arguments) < seq AS seen FROM e)
SELECT episode_id, count(*) AS turns, count(*) FILTER (WHERE seen) AS redundant FROM s GROUP BY episode_id""",
    ),
    "rolling_breaker": (
        rolling_breaker,
        f"""WITH {CALLS}, r AS (SELECT episode_id, seq, avg(failed::INT) OVER w AS rate, count(*) OVER w AS n FROM calls
WINDOW w AS (PARTITION BY episode_id ORDER BY ts, seq ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)) SELECT episode_id, seq, round(rate, 6) AS rate, n = 40 AND rate > 0.25 AS tripped FROM r""",
    ),
    "failure_clusters": (
        failure_clusters,
        f"""WITH {CALLS} SELECT episode_id, json_extract(arguments, '$.k')::BIGINT AS k, count(*) AS episodes, min(seq) AS first FROM calls WHERE failed GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "flags_summary": (
        flags_summary,
        rf"""WITH {MESSAGES}, r AS (SELECT *, lag(content) OVER (PARTITION BY episode_id ORDER BY turn) = content AND length(content) > 40 AS again FROM messages WHERE role = 'assistant' AND trim(content) <> ''),
f AS (SELECT episode_id,
  bool_or(length(content) > 600 OR regexp_matches(content, '(?im)(here''?s (the|a|your) (outcome|summary|picture|result|breakdown|overview)|^\s*#{{1,4}} |\n\s*\*\*[^*\n]{{2,40}}\*\*\s*\n\s*[-•])')) AS report,
  bool_or(regexp_matches(content, '(?i)\b(let me (check|look|get|find|verify|pull|see)|i''ll (check|look|get|find|pull)|i will (check|look|get|find))\b')) AS announce,
  bool_or(coalesce(again, false)) AS repeat, bool_or(regexp_matches(content, '[A-Za-z]+_[A-Za-z_]+|\b[0-9]+\s*cents?\b')) AS leak, false AS language FROM r GROUP BY episode_id),
u AS (SELECT unnest(['report', 'announce', 'repeat', 'leak', 'language']) AS flag, unnest([report, announce, repeat, leak, language]) AS hit FROM f)
SELECT flag, count(*) AS n, round(count(*) / (SELECT count(*) FROM f), 6) AS rate FROM u WHERE hit GROUP BY flag""",
    ),
    "result_dependency": (
        result_dependency,
        f"""WITH {CALLS}, v AS (SELECT episode_id, seq, name, arguments AS value FROM calls WHERE name IN ('view', 'purchase'))
SELECT episode_id, coalesce(bool_or(name = 'purchase' AND EXISTS (SELECT 1 FROM v b WHERE b.episode_id = v.episode_id AND b.name = 'view' AND b.value = v.value AND b.seq < v.seq)), false) AS depends FROM v GROUP BY episode_id""",
    ),
    "gold_match": (
        gold_match,
        f"""WITH {CALLS}, k AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ts, seq) AS k FROM calls),
p AS (SELECT g.episode_id, g.k AS gold_idx, g.name, m.k AS call_idx, (m.arguments <> g.arguments)::INT AS d FROM (SELECT * FROM k WHERE ts < '2024-01-16') g LEFT JOIN (SELECT * FROM k WHERE ts >= '2024-01-16') m ON m.episode_id = g.episode_id AND m.name = g.name),
r AS (SELECT *, row_number() OVER (PARTITION BY episode_id, gold_idx ORDER BY d, call_idx) AS place FROM p)
SELECT episode_id, gold_idx::INT AS gold_idx, name, CASE WHEN call_idx IS NULL THEN 'missing' WHEN d = 0 THEN 'exact' ELSE 'arguments' END AS kind, coalesce(call_idx, -1)::INT AS call_idx, coalesce(d, 0)::INT AS differing FROM r WHERE place = 1""",
    ),
    "scheduled_events": (
        scheduled_events,
        f"""WITH {CALLS}, l AS (SELECT episode_id AS row_id, name AS "column", value, row_number() OVER (PARTITION BY episode_id, name ORDER BY ts DESC, seq::VARCHAR DESC) AS k FROM calls WHERE ts <= TIMESTAMP '2024-01-11')
SELECT row_id, "column", round(value, 6) AS value FROM l WHERE k = 1
UNION ALL SELECT DISTINCT episode_id, 'click', 0.0::DOUBLE FROM calls c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.row_id = c.episode_id AND l."column" = 'click')""",
    ),
    "contiguous_ack": (
        contiguous_ack,
        f"""WITH {CALLS}, d AS (SELECT DISTINCT episode_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day FROM calls),
g AS (SELECT episode_id, day - row_number() OVER (PARTITION BY episode_id ORDER BY day) + 1 AS gap FROM d) SELECT episode_id, count(*) FILTER (WHERE gap = 0) AS position FROM g GROUP BY episode_id""",
    ),
    "learning_signals": (
        learning_signals,
        f"""WITH {CALLS}, r AS (SELECT CASE name WHEN 'purchase' THEN 'rollout_received' WHEN 'error' THEN 'environment_quarantined' WHEN 'signup' THEN 'optimizer_step' ELSE 'skip' END AS event, episode_id AS task_id,
  json_extract(arguments, '$.k')::INT AS k, seq, name FROM calls),
d AS (SELECT *, row_number() OVER (PARTITION BY event, task_id, k ORDER BY seq) AS place, event = 'rollout_received' AS got FROM r),
j AS (SELECT *, got AND k % 10 <> 0 AS measured FROM d WHERE event NOT IN ('rollout_received', 'environment_quarantined') OR place = 1),
a AS (SELECT coalesce(task_id, -1) AS task_id, grouping(task_id)::INT AS total, count(*) FILTER (WHERE got) AS rollout_groups, count(*) FILTER (WHERE got AND k % 10 = 0) AS unmeasured_groups,
  coalesce(sum(8) FILTER (WHERE measured), 0)::BIGINT AS episodes, coalesce(sum(k % 9) FILTER (WHERE got), 0)::BIGINT AS successes, count(*) FILTER (WHERE measured AND k % 2 = 0) AS eligible_groups,
  count(*) FILTER (WHERE measured AND k % 4 = 0) AS zero_advantage_groups, count(*) FILTER (WHERE measured AND k % 5 = 0) AS all_success_groups, count(*) FILTER (WHERE measured) AS measured_groups,
  count(*) FILTER (WHERE event = 'environment_quarantined') AS quarantined_jobs, count(*) FILTER (WHERE event = 'optimizer_step') AS optimizer_steps,
  count(*) FILTER (WHERE name = 'view') AS admission_rejections, count(*) FILTER (WHERE name = 'view' AND k % 3 = 0) AS optimizer_steps_skipped FROM j GROUP BY ROLLUP (task_id))
SELECT *, round(successes / nullif(episodes, 0), 6) AS reward_success_rate, round(zero_advantage_groups / nullif(eligible_groups, 0), 6) AS grpo_zero_advantage_rate,
  round(all_success_groups / nullif(measured_groups, 0), 6) AS all_success_group_rate, round(optimizer_steps / nullif(optimizer_steps + optimizer_steps_skipped, 0), 6) AS optimizer_step_execution_rate,
  round(quarantined_jobs / nullif(rollout_groups + quarantined_jobs, 0), 6) AS quarantined_job_rate FROM a""",
    ),
    "interval_overlap": (
        interval_overlap,
        """SELECT o_custkey AS group_id, o_orderkey AS episode_id FROM orders a WHERE o_orderstatus <> 'P' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P'
AND a.o_orderdate < b.o_orderdate + INTERVAL 10 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 10 DAY)""",
    ),
    "signature_messages": (
        signature_messages,
        rf"""WITH {MESSAGES}, l AS (SELECT episode_id, max_by(content, turn) AS c FROM messages WHERE role = 'assistant' AND content <> '' GROUP BY episode_id),
k AS (SELECT DISTINCT m.episode_id, substr(trim(regexp_replace(lower(coalesce(c, '')), '\s+', ' ', 'g')), 1, 160) AS words FROM messages m LEFT JOIN l ON l.episode_id = m.episode_id)
SELECT words, count(*) AS episodes, min(episode_id) AS first FROM k GROUP BY words""",
    ),
    "training_examples": (
        training_examples,
        f"""WITH {MESSAGES}, n AS (SELECT episode_id, role, row_number() OVER w AS turn, sum(length(content)) OVER w AS characters FROM messages WINDOW w AS (PARTITION BY episode_id ORDER BY turn))
SELECT episode_id, turn::INT AS turn, turn::INT AS messages, characters::BIGINT AS characters FROM n WHERE role = 'assistant'""",
    ),
    "curriculum": (
        curriculum,
        f"""WITH RECURSIVE {CALLS}, k AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ts, seq) - 1 AS k FROM calls), g AS (SELECT episode_id AS task_id, k // 10 AS a, avg((NOT failed)::INT) AS rate FROM k GROUP BY 1, 2),
w AS (SELECT DISTINCT task_id, -1::BIGINT AS a, 0 AS level, NULL::DOUBLE AS last FROM g UNION ALL
SELECT g.task_id, g.a, level + coalesce(last >= 0.75 AND rate >= 0.75 AND level < 4, false)::INT, CASE WHEN coalesce(last >= 0.75 AND rate >= 0.75 AND level < 4, false) THEN NULL ELSE rate END FROM w JOIN g ON g.task_id = w.task_id AND g.a = w.a + 1)
SELECT task_id, max_by(level, a)::INT AS level FROM w GROUP BY 1""",
    ),
}
