"""Queries on comparison, partial credit, rewards, worlds and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.operators import grading as G
from tidewright.operators import graph, joins, metrics, worlds
from tidewright.sources import tables as T


def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines differ between a state with all lines and one without the returned ones, quantities cut to ten."""
    lines = T.table(spark, sf_dir, "lineitem")
    row = F.concat_ws("|", F.col("l_linenumber"), F.col("l_quantity").cast("int"))
    cut = F.concat_ws("|", F.col("l_linenumber"), F.least(F.col("l_quantity").cast("int"), F.lit(45)))
    before = lines.select("l_orderkey", row.alias("row"))
    after = lines.where("l_returnflag <> 'R'").select("l_orderkey", cut.alias("row"))
    out = joins.state_diff(before, after, ["l_orderkey"], "row")
    return out.select("l_orderkey", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


def normalize_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and dates written in different ways, compared in normal form."""
    o = T.table(spark, sf_dir, "orders")
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    grouped = F.concat(F.lit("$"), F.format_number(cents, 2))
    odd = F.col("o_orderkey") % 2 == 1
    return o.select(
        "o_orderkey",
        S.normal_text(F.when(odd, grouped).otherwise(cents.cast("string"))).alias("price"),
        S.normal_text(F.when(odd, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))).alias("moment"),
        S.normal_text(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        S.normal_text(F.when(odd, F.concat(F.lit(" "), F.upper("o_orderpriority"))).otherwise(F.lower("o_orderpriority"))).alias("priority"),
    )


def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial credit of orders against their first line: price and day are substance, the flag is required."""
    a = T.table(spark, sf_dir, "orders")
    lines = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_quantity").alias("q"), F.max("l_quantity").alias("q2"), F.min("l_returnflag").alias("f"), F.max("l_returnflag").alias("f2"), F.min("l_linenumber").alias("n"), F.max("l_linenumber").alias("n2")
    )
    j = a.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    leaf = lambda name, want, got, required: F.struct(F.lit(name).alias("path"), want.cast("string").alias("expected"), got.cast("string").alias("actual"), F.lit(required).alias("required"))
    leaves = j.select("o_orderkey", F.inline(F.array(leaf("quantity", F.col("q"), F.col("q2"), False), leaf("number", F.col("n"), F.col("n2"), False), leaf("flag", F.col("f"), F.col("f2"), True))))
    scored = G.object_scores(G.leaf_matches(leaves.withColumn("internal", F.lit(False))), ["o_orderkey"])
    return scored.select("o_orderkey", F.round("score", 6).alias("score"))


def reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of orders as episodes: the score as one field, the status as the state, lines as calls."""
    scores = field_scores(spark, sf_dir)
    lines = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("calls"))
    o = T.table(spark, sf_dir, "orders").join(scores, "o_orderkey").join(lines, "o_orderkey")
    graded = G.reward(
        has_effects=F.col("o_orderstatus") != "O", state_ok=F.col("o_orderstatus") != "P", fields=F.lit(1), scores=F.col("score"), all_right=F.col("score") == 1.0, calls=F.col("calls"),
        reference=F.lit(1), violations=(F.col("o_orderpriority") == "1-URGENT").cast("int"), well_formed=F.lit(True),
    )
    return o.select("o_orderkey", graded["success"].alias("success"), F.round(graded["efficiency"], 6).alias("efficiency"), F.round(graded["reward"], 5).alias("reward"))


def counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes and brands mutated and respelled: how often the grader errs."""
    p = T.table(spark, sf_dir, "part")
    leaf = F.inline(F.array(F.struct(F.col("p_size").cast("string").alias("expected"), F.lit("integer").alias("kind")), F.struct(F.col("p_brand").alias("expected"), F.lit("string").alias("kind"))))
    leaves = p.select("p_partkey", leaf)
    none = F.expr("cast(array() as array<string>)")
    wrong = leaves.select("expected", F.explode(G.mutations(F.col("expected"), F.col("kind"), none)).alias("actual"), F.lit(False).alias("should_pass"))
    same = leaves.select("expected", F.explode(G.equivalents(F.col("expected"), F.col("kind"))).alias("actual"), F.lit(True).alias("should_pass"))
    return G.grader_errors(wrong.unionByName(same))


def perturb_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty perturbed worlds of the nations: one to three cells each; only facts that any draw must obey are returned."""
    n = T.table(spark, sf_dir, "nation")
    cells = n.select(F.lit("nation").alias("table"), F.col("n_nationkey").cast("string").alias("row_id"), F.inline(F.array(
        F.struct(F.lit("size").alias("column"), F.lit("integer").alias("kind"), (F.col("n_regionkey") * 10).cast("string").alias("value")),
        F.struct(F.lit("open").alias("column"), F.lit("boolean").alias("kind"), (F.col("n_nationkey") % 2 == 0).cast("string").alias("value")),
        F.struct(F.lit("region_id").alias("column"), F.lit("integer").alias("kind"), F.col("n_regionkey").cast("string").alias("value")),
        F.struct(F.lit("since").alias("column"), F.lit("string").alias("kind"), F.lit("2024-02-28T23:30").alias("value")),
    )))
    return worlds.perturbed(cells, spark.range(1, 21).withColumnRenamed("id", "seed"))


def generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated table: a zero-filled sequence, a cycle and a constant."""
    rules = {"id": {"kind": "sequence", "start": 100, "step": 5, "prefix": "R", "width": 6}, "color": {"kind": "cycle", "values": ["red", "green", "blue"], "offset": 1}, "active": {"kind": "constant", "value": True}}
    return worlds.generated_table(spark, 500, rules, seed=4)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders o<k> and customers c<k>: an order is next to the customer's order before it, the first to the customer."""
    o = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("a"), F.concat(F.lit("c"), "o_custkey").alias("c"), "o_orderdate", "o_orderkey")
    edges = o.select("a", F.coalesce(F.lag("a").over(Window.partitionBy("c").orderBy("o_orderdate", "o_orderkey")), "c").alias("b"))
    nodes = edges.select(F.col("a").alias("id")).union(T.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"))).distinct()
    return nodes, edges


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(*_graph(spark, sf_dir))


def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes and components each split has; components are whole in one split."""
    nodes, edges = _graph(spark, sf_dir)
    out = graph.assign_splits(graph.components(nodes, edges))
    return out.groupBy("split").agg(F.count("*").alias("nodes"), F.count_distinct("root").alias("components"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty equal bins of event values."""
    out = metrics.histogram(T.table(spark, sf_dir, "events"), "value")
    return out.select("bin", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("total", 3).alias("total"), F.round("squares", 2).alias("squares"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and supplier names that name one row only."""
    c = T.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("row_id"), F.inline(F.array(F.struct(F.lit("name").alias("column"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("column"), F.col("c_mktsegment").alias("value")))))
    s = T.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("row_id"), F.lit("name").alias("column"), F.col("s_name").alias("value"))
    return joins.aliases(c.unionByName(s))


GRAPH = """e AS (SELECT 'o' || o_orderkey AS a, coalesce('o' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 'c' || o_custkey) AS b FROM orders),
ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS seen FROM ends UNION SELECT r.id, ends.b FROM r JOIN ends ON ends.a = r.seen),
labels AS (SELECT id, min(seen) AS root FROM r GROUP BY id UNION ALL SELECT 'c' || c_custkey, 'c' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))"""

SCORES = """l AS (SELECT l_orderkey AS k, min(l_quantity) = max(l_quantity) AS q, min(l_linenumber) = max(l_linenumber) AS n, min(l_returnflag) = max(l_returnflag) AS f, count(*) AS calls FROM lineitem GROUP BY 1),
s AS (SELECT o.*, calls, CASE WHEN q AND n AND f THEN 1.0::DOUBLE ELSE (q::INT + n::INT) / 2.0 * CASE WHEN f THEN 1 ELSE 0.5 END END AS score FROM orders o JOIN l ON k = o_orderkey)"""

QUERIES = {
    "state_diff": (
        state_diff,
        """WITH e AS (SELECT l_orderkey, l_linenumber || '|' || l_quantity::INT AS r, count(*) AS n FROM lineitem GROUP BY 1, 2),
a AS (SELECT l_orderkey, l_linenumber || '|' || least(l_quantity::INT, 45) AS r, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
d AS (SELECT coalesce(e.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(e.r, a.r) AS r, e.n AS en, a.n AS an FROM e FULL JOIN a ON e.l_orderkey = a.l_orderkey AND e.r = a.r WHERE coalesce(e.n, 0) <> coalesce(a.n, 0))
SELECT l_orderkey, coalesce(array_to_string(list_sort(list(r) FILTER (WHERE an IS NULL))[1:5], ','), '') AS missing, coalesce(array_to_string(list_sort(list(r) FILTER (WHERE en IS NULL))[1:5], ','), '') AS unexpected FROM d GROUP BY 1""",
    ),
    "normalize_compare": (
        normalize_compare,
        """SELECT o_orderkey, 'n:' || round(o_totalprice, 2) AS price, 't:' || strftime(o_orderdate, '%Y-%m-%dT%H:%M') || CASE WHEN o_orderkey % 2 = 0 AND second(o_orderdate) > 0 THEN strftime(o_orderdate, ':%S') ELSE '' END AS moment,
'd:' || strftime(o_orderdate, '%Y-%m-%d') AS day, 's:' || lower(replace(o_orderpriority, ' ', '')) AS priority FROM orders""",
    ),
    "field_scores": (field_scores, f"WITH {SCORES} SELECT o_orderkey, round(score, 6) AS score FROM s"),
    "reward": (
        reward,
        f"""WITH {SCORES}, e AS (SELECT *, CASE WHEN calls <= 4 THEN 1.0::DOUBLE ELSE greatest(0.0, (8 - calls) / 4.0) END AS efficiency, o_orderstatus <> 'O' AS fx, o_orderstatus <> 'P' AS ok, o_orderpriority <> '1-URGENT' AS safe FROM s),
r AS (SELECT *, safe AND ok AND score = 1 AS success, CASE WHEN fx THEN 0.475::DOUBLE ELSE 0 END AS sw FROM e)
SELECT o_orderkey, success, round(efficiency, 6) AS efficiency, round(CASE WHEN safe THEN CASE WHEN ok THEN sw ELSE 0 END + CASE WHEN NOT fx AND NOT ok THEN 0 ELSE 0.95 - sw END * score + CASE WHEN success THEN 0.05 * efficiency ELSE 0 END ELSE 0 END, 5) AS reward FROM r""",
    ),
    "counterfactuals": (
        counterfactuals,
        "SELECT count(*) * 7 AS probes, 0::BIGINT AS false_positives, 0::BIGINT AS false_negatives FROM part",
    ),
    "perturb_worlds": (
        perturb_worlds,
        """WITH c AS (SELECT n_nationkey::VARCHAR AS r, unnest([{'c': 'size', 'k': 'integer', 'v': (n_regionkey * 10)::VARCHAR}, {'c': 'open', 'k': 'boolean', 'v': (n_nationkey % 2 = 0)::VARCHAR}, {'c': 'since', 'k': 'string', 'v': '2024-02-28T23:30'}], recursive := true) FROM nation),
o AS (SELECT *, row_number() OVER (ORDER BY sha256('0:cell:nation:' || r || ':' || c)) - 1 AS p FROM c),
d AS (SELECT DISTINCT s AS seed, ('0x' || substr(sha256('0:cell' || i || ':' || s), 1, 8))::BIGINT % (SELECT count(*) FROM c) AS p FROM range(1, 21) a(s), range(3) b(i) WHERE i < ('0x' || substr(sha256('0:cells:' || s), 1, 8))::BIGINT % 3 + 1),
p AS (SELECT seed, r, c, k, v FROM d JOIN o USING (p)),
n AS (SELECT *, seed || ':nation:' || r || ':' || c AS key, list_sort(list_distinct(list_filter(list_concat([greatest(0, coalesce(try_cast(v AS BIGINT), 0) + x) for x in [-3, -2, -1, 1, 2, 3]], [0], (SELECT list(DISTINCT n_regionkey * 10) FROM nation)), lambda x: x <> try_cast(v AS BIGINT)))) AS o FROM p)
SELECT seed, 'nation' AS "table", r AS row_id, c AS "column", v AS old, CASE k WHEN 'boolean' THEN CASE v WHEN 'true' THEN 'false' ELSE 'true' END WHEN 'integer' THEN o[('0x' || substr(sha256('0:value:' || key), 1, 8))::BIGINT % len(o) + 1]::VARCHAR
ELSE strftime(TIMESTAMP '2024-02-28 23:30' + INTERVAL 1 MINUTE * [-4320, -1440, -120, -60, 60, 120, 1440, 4320][('0x' || substr(sha256('0:shift:' || key), 1, 8))::BIGINT % 8 + 1], '%Y-%m-%dT%H:%M') END AS new FROM n""",
    ),
    "generators": (generators, "SELECT 'R' || lpad((100 + range * 5)::VARCHAR, 6, '0') AS id, ['red', 'green', 'blue'][((range + 5) % 3 + 1)::INT] AS color, true AS active FROM range(500)"),
    "components": (
        components,
        f"WITH RECURSIVE {GRAPH} SELECT id, root FROM labels",
    ),
    "split_balance": (
        split_balance,
        f"""WITH RECURSIVE {GRAPH}, sizes AS (SELECT root, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, root) AS k FROM labels GROUP BY root),
walk AS (SELECT 0::BIGINT AS k, 0::BIGINT AS pick, [0, 0, 0, 0, 0, 0]::BIGINT[] AS loads UNION ALL
SELECT s.k, list_position(loads, list_min(loads)), list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + s.n ELSE x END) FROM walk JOIN sizes s ON s.k = walk.k + 1)
SELECT ['dev', 'holdout-1', 'holdout-2', 'holdout-3', 'holdout-4', 'holdout-5'][pick] AS split, sum(n)::BIGINT AS nodes, count(*) AS components FROM walk JOIN sizes USING (k) GROUP BY 1""",
    ),
    "histogram": (
        histogram,
        """WITH f AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w, sum(value) AS t, sum(value * value) AS q FROM events)
SELECT least(floor((value - lo) / w), 19)::INT AS bin, count(*) AS n, round(lo + w * least(floor((value - lo) / w), 19), 6) AS low, round(lo + w * (least(floor((value - lo) / w), 19) + 1), 6) AS high, round(t, 3) AS total, round(q, 2) AS squares
FROM events, f GROUP BY ALL""",
    ),
    "aliases": (
        aliases,
        """WITH v AS (SELECT 'c' || c_custkey AS row_id, c_name AS value FROM customer UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)
SELECT regexp_replace(lower(value), '\\s+', '', 'g') AS alias, min(row_id) AS row_id FROM v WHERE length(value) >= 3 GROUP BY 1 HAVING count(DISTINCT row_id) = 1""",
    ),
}
