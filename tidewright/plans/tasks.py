"""Queries on tasks of worlds: alternatives, answer fields, nested values, requests, scripts and mixed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import text as X
from tidewright.operators import worlds
from tidewright.sources import tables as T


def goal_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other values of an order's goal: another customer, another number of days, another decision."""
    o = T.table(spark, sf_dir, "orders")
    p = lambda name, kind, v: F.struct(F.lit(name).alias("parameter"), F.lit(kind).alias("kind"), v.cast("string").alias("value"))
    goals = o.select(F.col("o_orderkey").alias("task_id"), F.inline(F.array(p("who", "string", F.concat(F.lit("c"), "o_custkey")), p("days", "number", F.col("o_orderkey") % 4), p("approve", "boolean", F.col("o_orderstatus") == "F"))))
    rows = T.table(spark, sf_dir, "customer").select(F.lit("customers").alias("table"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_custkey").alias("place"))
    return worlds.goal_alternatives(goals, rows)


def task_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer fields of each customer's orders as goals."""
    o = T.table(spark, sf_dir, "orders")
    goals = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("process"))
    outcomes = o.select(F.col("o_orderpriority").alias("process")).distinct().where("process <> '5-LOW'").withColumn("description", F.when(F.col("process") > "2", F.concat(F.lit("how "), F.lower("process"))))
    return worlds.task_fields(goals, outcomes)


def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and whole numbers at any depth of a value made of each part."""
    p = T.table(spark, sf_dir, "part")
    text = F.concat(F.lit('{"a": ['), "p_size", F.lit(', {"b": "'), "p_brand", F.lit('", "c": [true, null, 1.5, ["'), "p_name", F.lit('"]]}], "d": '), F.when(F.col("p_partkey") % 2 == 0, "7").otherwise("[]"), F.lit("}"))
    return worlds.nested_values(p.select("p_partkey", text.alias("t")), "p_partkey", "t")


def composed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks on their nations."""
    n = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("world_id"), F.col("n_name").alias("title"), F.lit("be kind").alias("rules"))
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_nationkey").alias("world_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"), F.col("c_mktsegment").alias("facts"), F.lit(None).cast("string").alias("script"))
    return worlds.composed(n, c).select("task_id", "title", "rules", "facts")


ELEMENTS = {"vague": 0.4, "wrong_first": 0.2, "pushback": 0.3, "forgotten": 0.1}


def script_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script elements of customers as tasks, every fifth of them direct."""
    c = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.when(F.col("c_custkey") % 5 == 0, "direct").otherwise("complex").alias("shape"))
    return worlds.script_elements(c, ELEMENTS, most=2).select("task_id", F.array_join("elements", ",").alias("elements"))


def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each user's trace."""
    e = T.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "click", "chat").otherwise("tool")
    return worlds.step_counts(e.select(F.col("user_id").alias("episode_id"), kind.alias("kind"), F.col("event_type").alias("tool"), F.get_json_object("props", "$.k").alias("key")))


def natural_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as verdicts on rewritten openings: those that may stand."""
    k = F.col("o_orderkey")
    some = lambda on: F.when(on, F.array(F.lit("x"))).when(k % 2 == 0, F.expr("cast(array() as array<string>)"))
    ok = worlds.natural_accepted(red_flags=some(k % 7 == 0), natural=F.when(k % 11 > 0, k % 6), equivalent=k % 13 > 0, missing=some(k % 5 == 0), added=some(k % 9 == 0), restates=F.when(k % 17 > 0, k % 19 == 0))
    return T.table(spark, sf_dir, "orders").where(ok).select("o_orderkey")


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents of each language are kept once those that share an 8-gram with the benchmark are dropped."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return X.decontaminated(docs, "doc_id", "text", T.table(spark, sf_dir, "benchmark"), "text").groupBy("lang").agg(F.count("*").alias("kept"))


QUERIES = {
    "goal_alternatives": (
        goal_alternatives,
        """WITH c AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS k FROM customer)
SELECT o_orderkey AS task_id, 'who' AS parameter, 'c' || b.id AS other FROM orders JOIN c a ON a.id = o_custkey JOIN c b ON b.id <> a.id AND b.k <= 3 + (a.k <= 3)::INT
UNION ALL SELECT o_orderkey, 'days', CASE WHEN o_orderkey % 4 = 0 THEN x.zero ELSE CASE WHEN x.zero = '1' THEN o_orderkey % 4 + 1 ELSE o_orderkey % 4 * 2 + 3 END::BIGINT::VARCHAR END FROM orders, (VALUES ('1'), ('5')) x(zero)
UNION ALL SELECT o_orderkey, 'approve', (o_orderstatus <> 'F')::VARCHAR FROM orders""",
    ),
    "task_fields": (
        task_fields,
        """SELECT o_custkey AS task_id, 'goal_' || o_orderkey AS field, 'Goal ' || o_orderkey || ' (' || o_orderpriority || '):' || CASE WHEN o_orderpriority > '2' THEN ' how ' || lower(o_orderpriority) ELSE '' END AS description FROM orders WHERE o_orderpriority <> '5-LOW'""",
    ),
    "nested_values": (
        nested_values,
        """SELECT p_partkey AS id, p_size::VARCHAR AS value FROM part UNION ALL SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, p_name FROM part UNION ALL SELECT p_partkey, '7' FROM part WHERE p_partkey % 2 = 0""",
    ),
    "composed_requests": (
        composed_requests,
        "SELECT c_custkey AS task_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE n_name END AS title, 'be kind' AS rules, c_mktsegment AS facts FROM customer JOIN nation ON n_nationkey = c_nationkey",
    ),
    "script_elements": (
        script_elements,
        """WITH e(n, p, i) AS (VALUES ('vague', 0.4, 1), ('wrong_first', 0.2, 2), ('pushback', 0.3, 3), ('forgotten', 0.1, 4)), t AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0),
d AS (SELECT id, n, i, ('0x' || substr(sha256('0:script-' || n || ':' || id), 1, 8))::BIGINT / 4294967296.0 < p AS hit, sha256('0:extra-' || n || ':' || id) AS o FROM t, e),
c AS (SELECT id, coalesce(list(n ORDER BY i) FILTER (WHERE hit), [])[1:2] AS drawn, min_by(n, o) AS extra FROM d GROUP BY id), f AS (SELECT id, CASE WHEN len(drawn) = 0 THEN [extra] ELSE drawn END AS l FROM c)
SELECT id AS task_id, array_to_string(CASE WHEN list_has_any(l, ['wrong_first', 'forgotten']) OR ('0x' || substr(sha256('0:identity:' || id), 1, 8))::BIGINT / 4294967296.0 < 0.3 THEN list_append(l, 'identity') ELSE l END, ',') AS elements FROM f
UNION ALL SELECT c_custkey, '' FROM customer WHERE c_custkey % 5 = 0""",
    ),
    "step_counts": (
        step_counts,
        """SELECT user_id AS episode_id, CASE WHEN event_type = 'purchase' THEN 'confirm ' || (props->>'$.k') ELSE event_type END AS step, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1, 2""",
    ),
    "natural_openings": (
        natural_openings,
        """SELECT o_orderkey FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 6 >= 4 AND o_orderkey % 13 > 0 AND o_orderkey % 5 > 0 AND o_orderkey % 9 > 0 AND o_orderkey % 17 > 0 AND o_orderkey % 19 > 0""",
    ),
    "mixed_sources": (
        mixed_sources,
        r"""WITH b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM documents),
banned AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM b WHERE len(w) >= 8),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM d WHERE len(w) >= 8)
SELECT lang, count(*) AS kept FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM grams SEMI JOIN banned USING (gram)) GROUP BY 1""",
    ),
}
