"""Queries on messages, calls and their results, read from the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import certify
from tidewright.operators import episodes as E
from tidewright.operators import joins
from tidewright.sources import tables as T

M = """m AS (SELECT user_id AS episode_id, event_id AS msg_idx, k AS number, CASE WHEN event_type IN ('view', 'click') THEN 'assistant' WHEN event_type = 'signup' THEN 'user' ELSE 'tool' END AS role,
CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS n_calls, CASE WHEN event_type = 'error' THEN false WHEN event_type = 'purchase' THEN true END AS ok,
event_type = 'click' AS words, event_type = 'click' AND k % 3 = 0 AS asks FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))"""


def _calls(m: DataFrame) -> DataFrame:
    """The call of each message that makes one; even numbers write."""
    call = m.where("n_calls = 1").select("episode_id", "msg_idx", F.lit(0).alias("call_idx"), F.concat(F.lit("c"), "number").alias("call_id"), "number")
    return call.withColumn("write", F.col("number") % 2 == 0).withColumn("name", F.when(F.col("write"), "update_row").otherwise("get_row")).withColumn("arguments", F.format_string('{"consent":"yes","row":"%d"}', "number")).drop("number")


def failed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that own a failed result."""
    return E.failed_turns(T.event_messages(spark, sf_dir))


def last_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per episode: writes, and writes whose last words before them asked."""
    m = T.event_messages(spark, sf_dir)
    out = E.last_words_before(m, _calls(m))
    return out.groupBy("episode_id").agg(F.count("*").alias("writes"), F.count(F.when(F.col("asked"), 1)).alias("asked"))


def recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an episode recovered from a failed result."""
    return E.recoveries(T.event_messages(spark, sf_dir))


def idle_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of speech without a tool: their lengths, warnings and ends by episode."""
    m = T.event_messages(spark, sf_dir)
    turns = m.select("episode_id", F.col("msg_idx").alias("seq"), F.when(F.col("role") == "tool", "tool").otherwise("chat").alias("kind"))
    out = E.idle_closure(turns)
    return out.groupBy("episode_id").agg(F.max("run").alias("longest"), F.count(F.when(F.col("warned"), 1)).alias("warned"), F.count(F.when(F.col("closed"), 1)).alias("closed"))


def step_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results, errors and protocol errors per step of an episode."""
    m = T.event_messages(spark, sf_dir).withColumn("status", F.when(F.col("content").startswith("Error"), 400).otherwise(200))
    m = m.withColumn("role", F.when(F.col("role") == "user", "protocol_error").otherwise(F.col("role")))
    return certify.step_monitor(m)


def call_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call with the last result of its id."""
    m = T.event_messages(spark, sf_dir)
    return E.calls_with_results(_calls(m), m).select("episode_id", "msg_idx", "name", "result")


def committed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good writes of each episode, without their consent, in order."""
    m = T.event_messages(spark, sf_dir)
    out = joins.committed_writes(_calls(m).withColumn("failed", F.lit(False)))
    return out.select("episode_id", F.array_join("writes", ";").alias("writes"))


def call_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of an episode, those whose result is not used later, and identifiers that nobody gave."""
    m = T.event_messages(spark, sf_dir).withColumn("content", F.concat_ws(" ", "content", F.concat(F.lit("ref-"), F.lpad("number", 3, "0"), F.lit("x"))))
    calls = _calls(m).withColumn("failed", F.lit(False)).withColumn("result", F.concat(F.lit("ref-"), F.lpad(F.substring("call_id", 2, 3), 3, "0"), F.lit("x")))
    calls = calls.withColumn("arguments", F.format_string('{"row_id":"ref-%sx"}', F.lpad(((F.substring("call_id", 2, 3).cast("int") * 7) % 100).cast("string"), 3, "0")))
    return E.call_profile(m, calls)


def tool_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, silent runs and writes tried, over the users as simulations."""
    m = T.event_messages(spark, sf_dir)
    names = F.filter(F.collect_list(F.when(F.col("n_calls") == 1, F.when(F.col("number") % 2 == 0, "update_row").otherwise("get_row"))), lambda x: x.isNotNull())
    sims = m.groupBy("episode_id").agg(names.alias("calls"), F.collect_list(F.when(F.col("number") % 50 == 3, "I will look it up")).alias("texts"))
    return certify.tool_health(sims.withColumn("needs_write", F.col("episode_id") % 2 == 0))


def dialogue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the users' dialogues against their lines."""
    return certify.dialogue_report(certify.dialogue_stats(T.event_messages(spark, sf_dir)), {"user_replies": 3, "agent_turns": 3, "asks_first": 0.99})


QUERIES = {
    "failed_turns": (
        failed_turns,
        f"""WITH {M}, o AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN msg_idx END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM m)
SELECT DISTINCT episode_id, own AS msg_idx FROM o WHERE ok = false AND own IS NOT NULL""",
    ),
    "last_words": (
        last_words,
        f"""WITH {M}, o AS (SELECT *, last_value(CASE WHEN words THEN asks END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM m)
SELECT episode_id, count(*) AS writes, count(*) FILTER (WHERE last) AS asked FROM o WHERE n_calls = 1 AND number % 2 = 0 GROUP BY 1""",
    ),
    "recoveries": (
        recoveries,
        f"""WITH {M}, o AS (SELECT *, max(coalesce(ok, false)::INT) OVER (PARTITION BY episode_id ORDER BY msg_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
max(asks::INT) OVER (PARTITION BY episode_id ORDER BY msg_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS soon FROM m)
SELECT episode_id, bool_or(coalesce(ok = false, false) AND coalesce(greatest(later, soon), 0) = 1) AS recovered FROM o GROUP BY 1""",
    ),
    "idle_closure": (
        idle_closure,
        f"""WITH {M}, r AS (SELECT *, sum((role = 'tool')::INT) OVER (PARTITION BY episode_id ORDER BY msg_idx) AS r FROM m),
n AS (SELECT *, count(*) FILTER (WHERE role <> 'tool') OVER (PARTITION BY episode_id, r ORDER BY msg_idx) AS run FROM r)
SELECT episode_id, max(run) AS longest, count(*) FILTER (WHERE run = 3) AS warned, count(*) FILTER (WHERE run > 3) AS closed FROM n GROUP BY 1""",
    ),
    "step_monitor": (
        step_monitor,
        f"""WITH {M}, s AS (SELECT *, count(*) FILTER (WHERE role = 'assistant') OVER (PARTITION BY episode_id ORDER BY msg_idx) AS step FROM m)
SELECT episode_id, step, count(*) FILTER (WHERE role = 'tool') AS tool_results, count(*) FILTER (WHERE ok = false AND number % 2 = 0) AS tool_errors, count(*) FILTER (WHERE role = 'user') AS protocol_errors FROM s GROUP BY 1, 2""",
    ),
    "call_results": (
        call_results,
        f"""WITH {M}, t AS (SELECT episode_id, number, max_by(CASE WHEN ok THEN '{{"ok": true, "result": "' || number || '"}}' WHEN number % 2 = 0 THEN 'Error: ' || number ELSE '{{"ok": false, "error": "' || number || '"}}' END, msg_idx) AS result FROM m WHERE role = 'tool' GROUP BY 1, 2)
SELECT m.episode_id, m.msg_idx, CASE WHEN m.number % 2 = 0 THEN 'update_row' ELSE 'get_row' END AS name, coalesce(result, '') AS result FROM m LEFT JOIN t USING (episode_id, number) WHERE n_calls = 1""",
    ),
    "committed_writes": (
        committed_writes,
        f"""WITH {M} SELECT episode_id, string_agg('update_row {{"row":"' || number || '"}}', ';' ORDER BY msg_idx) AS writes FROM m WHERE n_calls = 1 AND number % 2 = 0 GROUP BY 1""",
    ),
    "call_profile": (
        call_profile,
        f"""WITH {M}, c AS (SELECT *, number * 7 % 100 AS asked FROM m WHERE n_calls = 1),
said AS (SELECT episode_id, number AS v, min(CASE WHEN role <> 'assistant' THEN msg_idx END) AS first, max(CASE WHEN role = 'assistant' THEN msg_idx END) AS last FROM m GROUP BY 1, 2),
called AS (SELECT episode_id, asked AS v, max(msg_idx) AS last FROM c GROUP BY 1, 2)
SELECT c.episode_id, count(*) FILTER (WHERE c.number % 2 = 1) AS lookups,
count(*) FILTER (WHERE c.number % 2 = 1 AND c.number <> c.asked AND greatest(coalesce(s.last, -1), coalesce(k.last, -1)) <= c.msg_idx) AS unused, sum((coalesce(a.first, 1e18) >= c.msg_idx)::INT)::BIGINT AS invented
FROM c LEFT JOIN said s ON s.episode_id = c.episode_id AND s.v = c.number LEFT JOIN called k ON k.episode_id = c.episode_id AND k.v = c.number LEFT JOIN said a ON a.episode_id = c.episode_id AND a.v = c.asked GROUP BY 1""",
    ),
    "tool_health": (
        tool_health,
        f"""WITH {M}, s AS (SELECT episode_id, count(*) FILTER (WHERE n_calls = 1) AS calls, count(*) FILTER (WHERE n_calls = 1 AND number % 2 = 0) AS tried, count(*) FILTER (WHERE number % 50 = 3) AS said FROM m GROUP BY 1)
SELECT round_even(sum(calls) / count(*), 1) AS calls_per_sim, round_even(avg((calls = 0)::INT), 3) AS no_call_sims, round_even(sum(said) / count(*), 2) AS announce_without_call,
round_even(count(*) FILTER (WHERE episode_id % 2 = 0 AND tried > 0) / greatest(count(*) FILTER (WHERE episode_id % 2 = 0), 1), 3) AS write_attempted FROM s""",
    ),
    "dialogue_report": (
        dialogue_report,
        f"""WITH {M}, a AS (SELECT *, max((n_calls > 0)::INT) OVER (PARTITION BY episode_id ORDER BY msg_idx) AS called FROM m),
s AS (SELECT episode_id, greatest(count(*) FILTER (WHERE role = 'user') - 1, 0) AS u, count(*) FILTER (WHERE role = 'assistant') AS g, bool_or(asks AND called = 0) AS f FROM a GROUP BY 1)
SELECT count(*) AS episodes, median(u) AS user_replies, median(g) AS agent_turns, round_even(avg(f::INT), 3) AS asks_first, median(u) >= 3 AND median(g) >= 3 AND round_even(avg(f::INT), 3) >= 0.99 AS passed FROM s""",
    ),
}
