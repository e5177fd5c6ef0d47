"""Queries on named records, identities of groups, readiness of results and verdicts on runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import contracts, episodes, grading, joins, records
from tidewright.plans import episodes as behaviour
from tidewright.plans import turns
from tidewright.plans.selection import resamples
from tidewright.sources import tables as T


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and segments of customers, of which every third is written small, as cells."""
    c = T.table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_name")).otherwise(F.col("c_name"))
    return c.select(F.concat(F.lit("c"), "c_custkey").alias("row_id"), "c_nationkey", F.inline(F.array(F.struct(F.lit("name").alias("column"), F.replace(name, F.lit("#"), F.lit("")).alias("value")), F.struct(F.lit("number").alias("column"), F.col("c_custkey").cast("string").alias("value")))))


def referable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose name a person can say."""
    return records.referable_ids(_cells(spark, sf_dir))


def known_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the user of each nation knows: the opening, the region's number, and the customers that can be named."""
    n = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("request_id"), F.concat(F.lit("about "), "n_name").alias("user_request"), "n_regionkey")
    facts = n.select("request_id", F.col("n_regionkey").cast("string").alias("value"))
    out = records.known_strings(n, facts, _cells(spark, sf_dir).withColumn("request_id", F.col("c_nationkey")))
    return out.select("request_id", F.size("known").alias("n"), F.sha2(F.array_join("known", "|").cast("binary"), 256).alias("digest"))


def alias_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial credit of orders whose answers name the customer by number, by name or wrongly, and give the price or not."""
    o = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = joins.aliases(_cells(spark, sf_dir).drop("c_nationkey"))
    k = F.col("o_orderkey")
    who = F.when(k % 4 == 0, F.concat(F.lit("c"), "o_custkey")).when(k % 4 == 1, F.replace("c_name", F.lit("#"), F.lit(" "))).when(k % 4 == 2, "nobody")
    leaf = lambda path, want, got, required: F.struct(F.lit(path).alias("path"), want.cast("string").alias("expected"), got.cast("string").alias("actual"), F.lit(required).alias("required"), F.lit(False).alias("internal"))
    price = F.round("o_totalprice", 2)
    leaves = o.select("o_orderkey", F.inline(F.array(leaf("customer", F.concat(F.lit("c"), "o_custkey"), who, False), leaf("price", price, F.when(k % 3 > 0, price).otherwise(price + 1), False), leaf("status", F.col("o_orderstatus"), F.when(k % 5 > 0, F.col("o_orderstatus")).otherwise("X"), True))))
    matched = records.alias_matches(grading.leaf_matches(leaves), names)
    scored = grading.object_scores(matched.withColumn("matched", F.col("matched") | F.col("renamed")), ["o_orderkey"])
    return scored.select("o_orderkey", F.round("score", 6).alias("score"))


def record_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the customers that each nation's results returned, the first ten of them."""
    rows = T.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("episode_id"), (F.col("c_custkey") % 7).alias("seq"), F.col("c_custkey").alias("place"), (F.col("c_custkey") % 40).alias("row_id"),
        F.array(F.struct(F.lit("id").alias("column"), F.lit("x y").alias("value")), F.struct(F.lit("number").alias("column"), F.lit("12-34").alias("value")), F.struct(F.lit("name").alias("column"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("column"), F.col("c_mktsegment").alias("value"))).alias("cells"),
    )
    return records.record_names(rows, most=10).select("episode_id", "row_id", F.array_join("names", ",").alias("names"))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's agent said, in order."""
    m = T.event_messages(spark, sf_dir)
    trace = m.select("episode_id", F.col("msg_idx").alias("seq"), F.when((F.col("role") == "assistant") & (F.col("n_calls") == 0), "chat").otherwise("tool").alias("kind"), F.col("content").alias("message"))
    return records.speech(trace).select("episode_id", F.size("said").alias("n"), F.sha2(F.array_join("said", "|").cast("binary"), 256).alias("digest"))


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The behaviours that each user's episode shows."""
    m = T.event_messages(spark, sf_dir)
    calls = turns._calls(m).withColumn("failed", F.col("msg_idx") % 5 == 0).withColumn("result", F.lit(""))
    calls = calls.withColumn("name", F.when(F.col("msg_idx") % 50 == 3, "get_user_details").otherwise(F.col("name"))).withColumn("arguments", F.when(F.col("write"), '{"row": 1}').when(F.col("msg_idx") % 41 == 0, '{"proposal": 2}').when(F.col("msg_idx") % 43 == 0, '{"agreed": true}').otherwise("{}"))
    calls = calls.withColumn("consent", F.when(F.col("episode_id") % 5 == 0, "agreed"))
    e = m.select("episode_id").distinct().select("episode_id", F.when(F.col("episode_id") % 4 == 0, "flip:approve").otherwise("w1").alias("world"), (F.col("episode_id") % 3).alias("goals"), (F.col("episode_id") % 7 == 0).alias("out_of_scope"), F.lit(None).cast("boolean").alias("pushback"))
    out = records.skills(calls, episodes.last_words_before(m, calls), episodes.recoveries(m), e)
    return out.select("episode_id", F.array_join("skills", ",").alias("skills"))


def unsaid_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of an order that its opening leaves out."""
    k = F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Order "), k + 1000, F.lit(" cost "), F.when(k % 2 == 0, (k % 90 + 200).cast("string")).otherwise("something")).alias("opening"), F.array((k + 1000).cast("double"), (k % 90 + 200).cast("double")).alias("numbers"))
    out = records.unsaid_numbers(rows).where(F.size("missing") > 0)
    return out.select("o_orderkey", F.array_join(F.transform("missing", lambda x: x.cast("long").cast("string")), ",").alias("missing"))


def fact_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of each customer's facts: approvals of statuses, and priorities."""
    o = T.table(spark, sf_dir, "orders")
    facts = o.select(F.col("o_custkey").alias("request_id"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("approve_"), "o_orderkey")).otherwise(F.concat(F.lit("o"), "o_orderkey")).alias("key"), F.lit("true").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("description"))
    return records.fact_topics(facts).select("request_id", F.array_join("topics", ";").alias("topics"))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as actions of groups: an order's place among its customer's is the episode."""
    lines = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"))
    return lines.select(
        F.concat(F.lit("t"), F.col("l_orderkey") % 50).alias("task_id"), F.lit(None).cast("int").alias("place"), F.lit(3).alias("policy_version"), F.col("l_orderkey").alias("episode"), (F.col("l_linenumber") - 1).alias("action"),
        F.array_repeat(F.lit(1), F.col("q") % 4 + 1).alias("tokens"), F.when(F.col("l_orderkey") % 5 == 0, F.lit("g")).alias("group_id"), F.lit(None).cast("array<int>").alias("loss_mask"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of every action of every group."""
    return contracts.with_identities(_actions(spark, sf_dir)).select("group_id", "rollout_id", "segment_id", F.size("loss_mask").alias("trained"))


def identity_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions whose sandbox, group, rollout or policy version is another's, or whose segment stands twice."""
    rows = contracts.with_identities(_actions(spark, sf_dir)).withColumn("group", F.concat_ws("/", "task_id", "group_id"))
    groups = rows.select("group", "task_id", "group_id", F.lit(3).alias("policy_version")).distinct()
    episodes = rows.select("group", "episode", "rollout_id").distinct()
    e, a = F.col("episode"), F.col("action")
    moved = {
        "rollout_id": F.when(e % 70 == 0, F.concat(F.lit("x/"), "rollout_id")).otherwise(F.col("rollout_id")),
        "segment_id": F.when(a == 1, F.concat(F.col("rollout_id"), F.lit("/segment-0"))).otherwise(F.col("segment_id")),
        "sandbox_id": F.when(e % 33 == 1, "t").otherwise(F.col("sandbox_id")),
        "group_id": F.when(e % 44 == 2, "h").otherwise(F.col("group_id")),
        "policy_version": F.when(e % 52 == 3, 2).when(e % 61 != 4, 3),
    }
    return contracts.identity_problems(rows.withColumns(moved), groups, episodes)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("dataset_index"), (F.col("event_id") % 2).cast("int").alias("attempt"), F.col("ts").alias("finished_at"), (F.col("user_id") % 20).alias("batch"))


def ready_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the current attempt that are not consumed yet."""
    r = _results(spark, sf_dir)
    attempts = r.where("dataset_index % 3 = 0").select("dataset_index", F.lit(1).alias("attempt"))
    return contracts.ready_results(r, attempts, r.where("dataset_index % 10 = 4")).select("dataset_index")


def ready_minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in the mini-batches in which they can be consumed; some batches still miss results."""
    r = _results(spark, sf_dir)
    jobs = r.select("batch", "dataset_index")
    return contracts.ready_minibatches(r.where("batch % 2 = 0 or dataset_index % 9 > 0"), jobs, 7).select("batch", "dataset_index", "minibatch")


def ready_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 results of each of twenty epochs in mini-batches of seven."""
    return contracts.ready_count(_results(spark, sf_dir).withColumnRenamed("batch", "epoch"), 40, 7).select("epoch", "dataset_index", "minibatch")


def fork_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of each order's lines between those with a returned flag."""
    lines = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trunk"), F.col("l_linenumber").alias("action"), "l_returnflag")
    return contracts.fork_segments(lines.select("trunk", "action").distinct(), lines.where("l_returnflag = 'R'").select("trunk", F.col("action").alias("step")))


def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the second half of the customers against those of the first."""
    o = T.table(spark, sf_dir, "orders")
    rates = lambda rows: rows.agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("success"), F.avg((F.col("o_orderkey") % 3 == 0).cast("int")).alias("repeat_failures"), F.avg((F.col("o_orderstatus") == "P").cast("int")).alias("step_limit"), F.avg((F.col("o_custkey") % 2).cast("int")).alias("other"))
    long = lambda d: d.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c), 3).alias("value")) for c in d.columns])))
    return contracts.run_verdict(long(rates(o.where("o_custkey % 4 < 2"))), long(rates(o.where("o_custkey % 4 >= 2"))))


def paired_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain of late over early orders, by 200 resamples of the customers that have both, whatever their numbers of orders."""
    o = T.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("won"))
    out = contracts.paired_interval(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "won", draws=200)
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("p", 6).alias("p"))


def update_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the log-probabilities over all lines, an order being a sample."""
    lines = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), (F.col("l_orderkey") % 5 + 1).alias("weight"), (-F.col("l_discount")).alias("old_logp"), (-F.col("l_tax")).alias("new_logp"), (F.col("l_returnflag") != "R").alias("trained"))
    return contracts.update_kl(lines).select(F.round("kl", 8).alias("kl"))


def write_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How wanted calls were met, what differed and what was missing."""
    c = behaviour.gold_match(spark, sf_dir)
    rows = c.select("kind", "name", F.when(F.col("differing") > 0, F.array(F.lit("k"))).otherwise(F.expr("cast(array() as array<string>)")).alias("differing"))
    return contracts.write_failures(rows)


def leaf_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why values of orders (cents, shares, clock times, dates and priorities) were not matched, by what a sentence says of them."""
    k = F.col("o_orderkey")
    o = T.table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    type = F.when(k % 5 == 0, "integer").when(k % 5 == 1, "number").when(k % 5 == 2, "time").when(k % 5 == 3, "date").otherwise("enum")
    hour = F.lpad((k % 24).cast("string"), 2, "0")
    expected = F.when(k % 5 == 0, F.col("cents").cast("string")).when(k % 5 == 1, F.concat(F.lit("0."), k % 89 + 10)).when(k % 5 == 2, F.concat(hour, F.lit(":30"))).when(k % 5 == 3, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    clock = F.concat(F.when(k % 12 == 0, 12).otherwise(k % 12).cast("string"), F.lit(":30 "), F.when(k % 24 >= 12, "p.m.").otherwise("a.m."))
    words = F.when(k % 5 == 0, F.concat(F.lit("$"), F.format_number(F.col("cents") / 100, 2))).when(k % 5 == 1, F.concat((k % 89 + 10).cast("string"), F.lit("%"))).when(k % 5 == 2, clock).when(k % 5 == 3, F.date_format("o_orderdate", "MMMM d")).otherwise(F.upper(F.replace("o_orderpriority", F.lit("-"), F.lit(" "))))
    speech = F.when(k % 2 == 0, F.concat(F.lit("It is "), words, F.lit(", as you asked."))).otherwise("It is as you asked.")
    rows = o.select(type.alias("type"), expected.alias("expected"), F.when(k % 3 > 0, F.concat(F.lit("x"), k)).alias("actual"), speech.alias("speech"))
    return contracts.leaf_gaps(rows).select("kind", "type", "n", F.array_join("examples", ",").alias("examples"))


def goal_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer by number modulo five as goals of tasks, also of tasks without any; processes are named by priority."""
    o = T.table(spark, sf_dir, "orders")
    tasks = T.table(spark, sf_dir, "customer").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat_ws("-", "c_custkey", k))).alias("task_id"))
    k = F.col("o_orderkey")
    goals = o.select(F.concat_ws("-", "o_custkey", k % 5).alias("task_id"), F.substring("o_orderpriority", 3, 20).alias("process"), F.array(F.concat(F.lit("p"), k % 4), F.concat(F.lit("p"), k % 7), F.lit("p0")).alias("params"))
    processes = o.select(F.substring("o_orderpriority", 3, 20).alias("process")).distinct().where("process <> 'LOW'").withColumn("params", F.array(F.lit("p0"), F.lit("p1"), F.lit("p2")))
    return contracts.goal_problems(tasks, goals, processes)


def alternative_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer by number modulo four as outcomes, the first the main one, with the rows that they change and the schema's verdict."""
    task, k = F.concat_ws("-", "o_custkey", F.col("o_orderkey") % 4), F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select(task.alias("task_id"), (F.row_number().over(Window.partitionBy(task).orderBy(k)) - 1).alias("number"), F.col("o_orderstatus").alias("outcome"), (k % 3).alias("changes"), F.when(k % 11 == 0, F.array(F.lit("status is missing"))).alias("answer_problems"))
    return contracts.alternative_problems(rows)


def insensitive_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities of a customer whose orders all end alike."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("parameter"), F.col("o_orderstatus").alias("answer"), (F.col("o_orderkey") % 2).alias("state"))
    return contracts.insensitive_goals(o)


def approval_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as approval worlds whose confirmed key is another."""
    k = F.col("o_orderkey")
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), k.alias("world"), F.col("o_orderpriority").alias("approved"), F.when(k % 5 == 0, "1-URGENT").when(k % 7 > 0, F.col("o_orderpriority")).alias("confirmed"))
    return contracts.approval_problems(o)


def run_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How orders, read as sessions, ended."""
    k = F.col("o_orderkey")
    status = contracts.run_status(F.when(k % 4 == 0, "timeout").when(k % 4 == 1, "killed").otherwise("exited"), k % 3, F.when(k % 5 > 0, k % 2), k % 11 == 0)
    return T.table(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


NAMED = "named AS (SELECT 'c' || c_custkey AS row_id, c_nationkey, c_custkey, replace(CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) ELSE c_name END, '#', '') AS name FROM customer)"
ACTIONS = """a AS (SELECT l_orderkey AS e, l_linenumber - 1 AS a, max(l_quantity)::INT % 4 + 1 AS n, CASE WHEN l_orderkey % 5 = 0 THEN 'g' ELSE 't' || l_orderkey % 50 || ':0:3' END AS g FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

QUERIES = {
    "referable_ids": (referable_ids, f"WITH {NAMED} SELECT row_id FROM named WHERE regexp_matches(name, '[A-Z]') OR contains(trim(name), ' ')"),
    "known_strings": (
        known_strings,
        f"""WITH {NAMED}, k AS (SELECT n_nationkey AS request_id, 'about ' || n_name AS t FROM nation UNION SELECT n_nationkey, n_regionkey::VARCHAR FROM nation
UNION SELECT c_nationkey, row_id FROM named JOIN nation ON n_nationkey = c_nationkey WHERE regexp_matches(name, '[A-Z]') OR contains(trim(name), ' ') UNION SELECT c_nationkey, row_id FROM named WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) AND regexp_matches(name, '[A-Z]'))
SELECT request_id, count(*)::INT AS n, sha256(string_agg(t, '|' ORDER BY t)) AS digest FROM k GROUP BY 1""",
    ),
    "alias_scores": (
        alias_scores,
        f"""WITH {NAMED}, keys AS (SELECT regexp_replace(lower(name), '\\s+', '', 'g') AS key, min(row_id) AS row_id FROM named GROUP BY 1 HAVING count(DISTINCT row_id) = 1),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN coalesce(row_id = 'c' || o_custkey, false) ELSE false END AS who, o_orderkey % 3 > 0 AS price, o_orderkey % 5 > 0 AS status
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN keys ON key = regexp_replace(lower(replace(c_name, '#', ' ')), '\\s+', '', 'g'))
SELECT o_orderkey, round(CASE WHEN who AND price AND status THEN 1 ELSE (who::INT + price::INT) / 2.0 * CASE WHEN status THEN 1 ELSE 0.5 END END, 6) AS score FROM o""",
    ),
    "record_names": (
        record_names,
        """WITH c AS (SELECT c_nationkey AS e, c_custkey % 40 AS r, c_custkey % 7 AS s, c_custkey AS p, c_name || ',' || c_mktsegment AS names FROM customer), f AS (SELECT *, row_number() OVER (PARTITION BY e, r ORDER BY s, p) AS k FROM c),
g AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY s, p) AS place FROM f WHERE k = 1) SELECT e AS episode_id, r AS row_id, names FROM g WHERE place <= 10""",
    ),
    "speech": (
        speech,
        """WITH s AS (SELECT user_id AS episode_id, event_id, CASE WHEN (props->>'$.k')::INT % 3 = 0 THEN 'Is it ' || (props->>'$.k') || '?' ELSE 'It is ' || (props->>'$.k') END AS t FROM events WHERE event_type = 'click')
SELECT episode_id, count(*)::INT AS n, sha256(string_agg(t, '|' ORDER BY event_id)) AS digest FROM s GROUP BY 1""",
    ),
    "skills": (
        skills,
        f"""WITH {turns.M}, o AS (SELECT *, last_value(CASE WHEN words THEN asks END IGNORE NULLS) OVER w AS last, max(coalesce(ok, false)::INT) OVER (PARTITION BY episode_id ORDER BY msg_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
max(asks::INT) OVER (PARTITION BY episode_id ORDER BY msg_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS soon FROM m WINDOW w AS (PARTITION BY episode_id ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT episode_id, bool_or(n_calls = 1 AND ((number % 2 = 0 AND coalesce(last, false)) OR (number % 2 = 1 AND msg_idx % 41 = 0))) AS asks, bool_or(n_calls = 1 AND msg_idx % 5 > 0 AND (number % 2 = 0 OR (msg_idx % 41 > 0 AND msg_idx % 43 = 0 AND episode_id % 5 = 0))) AS writes, bool_or(n_calls = 1 AND msg_idx % 50 = 3) AS who,
bool_or(coalesce(ok = false, false) AND coalesce(greatest(later, soon), 0) = 1) AS back FROM o GROUP BY 1)
SELECT episode_id, concat_ws(',', CASE WHEN asks THEN 'asks_consent' END, CASE WHEN episode_id % 3 >= 2 THEN 'multi_goal' END, CASE WHEN episode_id % 7 = 0 THEN 'out_of_scope' END, CASE WHEN back THEN 'recovers_from_error' END,
CASE WHEN episode_id % 4 = 0 THEN 'refusal_world' END, CASE WHEN who THEN 'verifies_identity' END, CASE WHEN writes THEN 'writes' END) AS skills FROM s""",
    ),
    "unsaid_numbers": (unsaid_numbers, "SELECT o_orderkey, (o_orderkey % 90 + 200)::BIGINT::VARCHAR AS missing FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey + 1000 NOT IN ((o_orderkey % 90 + 200), (o_orderkey % 90 + 200) / 100)"),
    "fact_topics": (
        fact_topics,
        """WITH t AS (SELECT o_custkey AS request_id, CASE WHEN o_orderstatus = 'P' THEN 'approve_' || o_orderkey || ': approval' ELSE 'o' || o_orderkey || ': fact' END || ': ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS t FROM orders)
SELECT request_id, string_agg(t, ';' ORDER BY t) AS topics FROM t GROUP BY 1""",
    ),
    "identities": (identities, f"WITH {ACTIONS} SELECT g AS group_id, g || '/rollout-' || e AS rollout_id, g || '/rollout-' || e || '/segment-' || a AS segment_id, n AS trained FROM a"),
    "identity_problems": (
        identity_problems,
        f"""WITH {ACTIONS}, s AS (SELECT e, 't' || e % 50 || '/' || g AS "group", g || '/rollout-' || e || '/segment-' || CASE WHEN a = 1 THEN 0 ELSE a END AS segment_id FROM a)
SELECT "group", segment_id, 'repeated segment' AS problem FROM s GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT "group", segment_id, 'another rollout' FROM s WHERE e % 70 = 0 UNION ALL SELECT "group", segment_id, 'another sandbox' FROM s WHERE e % 33 = 1
UNION ALL SELECT "group", segment_id, 'another group' FROM s WHERE e % 44 = 2 UNION ALL SELECT "group", segment_id, 'another policy version' FROM s WHERE e % 52 = 3 OR e % 61 = 4""",
    ),
    "ready_results": (ready_results, "SELECT event_id AS dataset_index FROM events WHERE event_id % 10 <> 4 AND event_id % 2 = CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END"),
    "ready_minibatches": (
        ready_minibatches,
        """WITH j AS (SELECT user_id % 20 AS batch, event_id AS dataset_index, ts FROM events), n AS (SELECT batch, count(*) AS jobs FROM j GROUP BY 1),
p AS (SELECT *, (row_number() OVER (PARTITION BY batch ORDER BY ts, dataset_index) - 1) // 7 AS minibatch, count(*) OVER (PARTITION BY batch) AS there FROM j WHERE batch % 2 = 0 OR dataset_index % 9 > 0),
s AS (SELECT *, count(*) OVER (PARTITION BY batch, minibatch) AS n FROM p) SELECT batch, dataset_index, minibatch FROM s JOIN n USING (batch) WHERE s.n = 7 OR there = jobs""",
    ),
    "ready_count": (
        ready_count,
        """WITH r AS (SELECT user_id % 20 AS epoch, event_id AS dataset_index, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id % 20) AS n FROM events)
SELECT epoch, dataset_index, p // 7 AS minibatch FROM r WHERE p < 40 AND least((p // 7 + 1) * 7, 40) <= n""",
    ),
    "fork_segments": (
        fork_segments,
        """WITH l AS (SELECT l_orderkey AS trunk, l_linenumber AS action, max((l_returnflag = 'R')::INT) AS f FROM lineitem GROUP BY 1, 2), s AS (SELECT *, sum(f) OVER (PARTITION BY trunk ORDER BY action) AS segment FROM l)
SELECT trunk, segment::BIGINT AS segment, min(action) AS first, max(action) AS last FROM s GROUP BY 1, 2""",
    ),
    "run_verdict": (
        run_verdict,
        """WITH r AS (SELECT o_custkey % 4 < 2 AS m, round(avg((o_orderstatus = 'F')::INT), 3) AS s, round(avg((o_orderkey % 3 = 0)::INT), 3) AS f, round(avg((o_orderstatus = 'P')::INT), 3) AS l FROM orders GROUP BY 1),
v AS (SELECT m, 'success' AS metric, s AS value FROM r UNION ALL SELECT m, 'repeat_failures', f FROM r UNION ALL SELECT m, 'step_limit', l FROM r)
SELECT a.metric, a.value AS model, b.value AS base, CASE WHEN a.metric = 'success' THEN round(a.value - b.value, 9) < -0.05 ELSE round(a.value - b.value, 9) > 0.05 END AS failed FROM v a JOIN v b ON a.metric = b.metric AND a.m AND NOT b.m""",
    ),
    "paired_interval": (
        paired_interval,
        f"""WITH a AS (SELECT o_custkey AS k, o_orderkey % 2 AS side, sum((o_orderstatus = 'F')::INT) AS s, count(*) AS n FROM orders GROUP BY 1, 2),
t AS (SELECT k, a.s, a.n, b.s AS bs, b.n AS bn FROM a JOIN a b USING (k) WHERE a.side = 0 AND b.side = 1), {resamples("0", 200)},
m AS (SELECT draw, sum(w * bs) / sum(w * bn) - sum(w * s) / sum(w * n) AS mean FROM w GROUP BY 1), s AS (SELECT list_sort(list(mean)) AS l FROM m)
SELECT round(l[6], 6) AS low, round(l[195], 6) AS high, round(least(1, 2 * least((SELECT avg((mean <= 0)::INT) FROM m), (SELECT avg((mean >= 0)::INT) FROM m))), 6) AS p FROM s""",
    ),
    "update_kl": (
        update_kl,
        """WITH s AS (SELECT l_orderkey, l_orderkey % 5 + 1 AS w, avg(exp(l_discount - l_tax) - 1 - (l_discount - l_tax)) FILTER (WHERE l_returnflag <> 'R') AS k FROM lineitem GROUP BY 1) SELECT round(sum(w * k) / sum(w), 8) AS kl FROM s""",
    ),
    "leaf_gaps": (
        leaf_gaps,
        """WITH v AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'number' WHEN 2 THEN 'time' WHEN 3 THEN 'date' ELSE 'enum' END AS type,
CASE o_orderkey % 5 WHEN 0 THEN round(o_totalprice * 100)::BIGINT::VARCHAR WHEN 1 THEN '0.' || (o_orderkey % 89 + 10) WHEN 2 THEN lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':30' WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END AS expected FROM orders),
l AS (SELECT type, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'said but not extracted' ELSE 'not said' END WHEN k % 2 = 0 THEN 'said, another value extracted' ELSE 'wrong' END AS kind,
expected || CASE WHEN k % 3 > 0 THEN ' -> x' || k ELSE '' END AS e FROM v) SELECT kind, type, count(*) AS n, array_to_string(list_sort(list(e))[1:3], ',') AS examples FROM l GROUP BY 1, 2""",
    ),
    "goal_problems": (
        goal_problems,
        """WITH t AS (SELECT c_custkey || '-' || k AS task_id FROM customer, range(5) r(k)), g AS (SELECT o_custkey || '-' || o_orderkey % 5 AS task_id, substr(o_orderpriority, 3) AS process, list_distinct([o_orderkey % 4, o_orderkey % 7]) AS p FROM orders),
n AS (SELECT task_id, count(process) AS n FROM t LEFT JOIN g USING (task_id) GROUP BY 1), f AS (SELECT *, list_sort(list_filter(p, lambda x: x > 2)) AS u FROM g JOIN n USING (task_id) WHERE n BETWEEN 1 AND 3)
SELECT task_id, 'not one to three goals' AS problem FROM n WHERE n NOT BETWEEN 1 AND 3
UNION ALL SELECT DISTINCT task_id, CASE WHEN process = 'LOW' THEN 'unknown process LOW' ELSE 'unknown parameters of ' || process || ': ' || array_to_string(list_transform(u, lambda x: 'p' || x), ', ') END FROM f WHERE process = 'LOW' OR len(u) > 0""",
    ),
    "alternative_problems": (
        alternative_problems,
        """WITH o AS (SELECT o_custkey || '-' || o_orderkey % 4 AS task_id, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey) - 1 AS number, o_orderstatus AS outcome, o_orderkey % 3 AS changes, o_orderkey % 11 = 0 AS bad FROM orders),
a AS (SELECT *, min(number) OVER (PARTITION BY task_id, outcome) AS first, max(number) OVER (PARTITION BY task_id) AS n, first_value(changes) OVER (PARTITION BY task_id ORDER BY number) AS main FROM o)
SELECT task_id, 0 AS number, 'too many alternatives' AS problem FROM a WHERE number = 0 AND n > 3 UNION ALL SELECT task_id, number::INT, 'status is missing' FROM a WHERE number > 0 AND n <= 3 AND bad
UNION ALL SELECT task_id, number::INT, 'repeats another outcome' FROM a WHERE n <= 3 AND first < number
UNION ALL SELECT task_id, number::INT, 'leaves the world unchanged although the main outcome changes it' FROM a WHERE number > 0 AND n <= 3 AND main > 0 AND changes = 0""",
    ),
    "insensitive_goals": (insensitive_goals, "SELECT o_custkey AS task_id, o_orderpriority AS parameter FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) = 1 AND count(DISTINCT o_orderkey % 2) = 1"),
    "approval_mismatches": (
        approval_mismatches,
        "SELECT o_custkey AS task_id, o_orderkey AS world, o_orderpriority AS key FROM orders WHERE CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority <> '1-URGENT' ELSE o_orderkey % 7 = 0 END",
    ),
    "run_statuses": (
        run_statuses,
        """WITH s AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'timeout' WHEN o_orderkey % 4 = 1 THEN 'killed' ELSE 'exited' END AS s, o_orderkey % 3 > 0 AS bad, o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 2 = 0 AS un FROM orders)
SELECT CASE WHEN un AND (s = 'timeout' OR (s = 'exited' AND bad)) THEN 'infrastructure_error' ELSE s END AS status, count(*) AS n FROM s GROUP BY 1""",
    ),
    "write_failures": (
        write_failures,
        f"""WITH {behaviour.CALLS}, k AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ts, seq) AS k FROM calls),
p AS (SELECT g.episode_id, g.k, g.name, m.k AS mk, (m.arguments <> g.arguments)::INT AS d FROM (SELECT * FROM k WHERE ts < '2024-01-16') g LEFT JOIN (SELECT * FROM k WHERE ts >= '2024-01-16') m ON m.episode_id = g.episode_id AND m.name = g.name),
r AS (SELECT name, CASE WHEN mk IS NULL THEN 'missing' WHEN d = 0 THEN 'exact' ELSE 'arguments' END AS kind, row_number() OVER (PARTITION BY episode_id, k ORDER BY d, mk) AS place FROM p), x AS (SELECT * FROM r WHERE place = 1)
SELECT 'match' AS kind, kind AS item, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'argument', 'k', count(*) FROM x WHERE kind = 'arguments' HAVING count(*) > 0 UNION ALL (SELECT 'tool', name, count(*) FROM x WHERE kind = 'missing' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""",
    ),
}
