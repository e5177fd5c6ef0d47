"""Queries on world states: differences, created rows, shapes, overlays, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import certify, joins, validators, worlds
from tidewright.sources import tables as T


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a state: status and priority are cells."""
    o = T.table(spark, sf_dir, "orders")
    cells = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    return o.select(F.lit("orders").alias("table"), F.col("o_orderkey").alias("row_id"), cells.alias("cells"))


def _later(rows: DataFrame) -> DataFrame:
    """The state after: every third order's status becomes F, every fifth's priority is raised, every seventh is gone."""
    status = F.when(F.col("row_id") % 3 == 0, "F").otherwise(F.col("cells")["status"])
    priority = F.when(F.col("row_id") % 5 == 0, "1-URGENT").otherwise(F.col("cells")["priority"])
    return rows.where("row_id % 7 <> 0").withColumn("cells", F.create_map(F.lit("status"), status, F.lit("priority"), priority))


def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of kept orders that differ between the two states."""
    rows = _orders(spark, sf_dir)
    return joins.changed_cells(rows, _later(rows), ["row_id"])


def state_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation for each changed cell: what it is now and what putting it back gives."""
    rows = _orders(spark, sf_dir)
    return joins.state_mutations(rows, _later(rows), ["row_id"])


def state_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the orders differ from themselves, and from the state after."""
    rows = _orders(spark, sf_dir).select("row_id", F.map_entries("cells").alias("cells"))
    later = _later(_orders(spark, sf_dir)).select("row_id", F.map_entries("cells").alias("cells"))
    return spark.range(1).select(F.lit(joins.state_changed(rows, rows)).alias("same"), F.lit(joins.state_changed(rows, later)).alias("later"))


def sibling_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first other suppliers of each supplier's nation."""
    rows = T.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("table"), F.col("s_suppkey").alias("id"))
    return joins.sibling_ids(rows).select("id", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


def skipped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that an order's later lines have and no line with the other flag takes."""
    lines = T.actions(spark, sf_dir).join(T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("part"), "l_returnflag").distinct(), ["episode_id", "part"])
    trace = lines.select("episode_id", F.col("line").alias("seq"), F.col("part").alias("step"), "l_returnflag", F.lit(1).alias("after"))
    out = joins.skipped_steps(trace.where("l_returnflag = 'R'"), trace.where("l_returnflag <> 'R'"), "after")
    return out.groupBy("episode_id").agg(F.count_distinct("step").alias("steps"))


def accepted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of scheduled jobs: the first arrival that fits its job."""
    e = T.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    results = e.select((F.col("user_id") * 100 + k).alias("dataset_index"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("attempt"), F.col("user_id").alias("task_id"), k.alias("seed"), F.col("ts").alias("finished_at"), "event_id")
    jobs = results.select("dataset_index", F.lit(1).alias("attempt"), "task_id", "seed").distinct().where("dataset_index % 2 = 0")
    order = joins.accept_results(results.withColumn("attempt", F.col("attempt").cast("int")), jobs)
    return order.select("dataset_index", "task_id", "event_id")


def masked_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers with equal numbers, of which the customers above 50 are new: only they, and what names them, are masked."""
    c = T.table(spark, sf_dir, "customer").select(F.lit("customer").alias("table"), F.col("c_custkey").cast("string").alias("row_id"), F.create_map(F.lit("id"), F.col("c_custkey").cast("string")).alias("cells"))
    s = T.table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("table"), F.col("s_suppkey").cast("string").alias("row_id"), F.create_map(F.lit("customer_id"), F.col("s_suppkey").cast("string")).alias("cells"))
    initial = c.where("cast(row_id as long) <= 50").unionByName(s)
    out = certify.masked_created(c.unionByName(s), initial, references={"customer_id": "customer"})
    return out.groupBy("table").agg(F.count("*").alias("rows"), F.count(F.when(F.col("row_id") == "<new>", 1)).alias("masked_rows"), F.count(F.when(F.exists(F.map_values("cells"), lambda v: v == "<new>"), 1)).alias("masked_cells"))


def state_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column sets of each nation's customers, of whom the rich have one more."""
    c = T.table(spark, sf_dir, "customer")
    cells = F.when(F.col("c_acctbal") > 5000, F.create_map(F.lit("name"), "c_name", F.lit("limit"), F.lit("1"))).otherwise(F.create_map(F.lit("name"), "c_name"))
    return certify.state_shape(c.select(F.col("c_nationkey").alias("table"), cells.alias("cells"))).select("table", F.array_join("shapes", ";").alias("shapes"))


def shape_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose columns are not those of any order before, once every eleventh has lost its priority."""
    rows = _orders(spark, sf_dir)
    after = rows.withColumn("cells", F.when(F.col("row_id") % 11 == 0, F.map_filter("cells", lambda k, v: k != "priority")).otherwise(F.col("cells")))
    return validators.shape_changes(rows, after)


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches on orders: what fits is applied, what fits nothing is told."""
    rows = _orders(spark, sf_dir)
    number = F.col("row_id") * F.when(F.col("row_id") % 2 == 0, 1).otherwise(-1)
    patches = rows.where("row_id % 4 < 3").select("table", number.alias("row_id"), F.when(F.col("row_id") % 4 == 0, F.create_map(F.lit("color"), F.lit("red"))).otherwise(F.create_map(F.lit("status"), F.lit("X"))).alias("set"))
    fixed, bad = worlds.overlay(rows, patches)
    done = fixed.where("cells['status'] = 'X'").select("row_id", F.lit("applied").alias("result"))
    return done.unionByName(bad.select("row_id", F.col("problem").alias("result")))


def value_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least distinct values of the columns of parts."""
    p = T.table(spark, sf_dir, "part")
    cell = lambda name, kind: F.struct(F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("value"))
    cells = p.select(F.inline(F.array(cell("p_brand", "string"), cell("p_type", "string"), cell("p_size", "integer"))))
    return worlds.value_pool(cells, show=10).select("column", "kind", F.array_join("values", ",").alias("values"))


def approval_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worlds with one approval of each order turned round."""
    facts = F.create_map(F.lit("approve_status"), F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"), F.lit("approve_price"), (F.col("o_totalprice") > 1000).cast("string"), F.lit("name"), F.lit("true"))
    out = worlds.approval_flips(T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), facts.alias("facts")))
    return out.select("request_id", "world", F.col("facts")["approve_status"].alias("approve_status"), F.col("facts")["approve_price"].alias("approve_price"))


def unrepaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps (event types by user) that occur less often in the second half of the month than in the first, refused ones discounted."""
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("step"), (F.col("ts") < F.lit("2024-01-16")).alias("first"))
    refused = e.where("task_id % 3 = 0 and step = 'error'").select("task_id", "step")
    return certify.unrepaired(e.where("first"), e.where("not first"), e.where("first"), refused)


def _audit(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("item"), "o_orderstatus", "o_orderpriority")
    verdict = F.when(F.col("item") % 10 == 0, "maybe").when(F.col("o_orderstatus") == "P", "wrong").otherwise("consistent")
    return o, verdict


def audit_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on orders that are illegal, quote nothing, or are missing."""
    o, verdict = _audit(spark, sf_dir)
    rows = o.where("item % 9 <> 0").select("task_id", "item", verdict.alias("verdict"), F.when(F.col("item") % 2 == 0, F.col("o_orderpriority")).otherwise("none of it").alias("quote"), F.concat(F.lit("priority  is "), "o_orderpriority").alias("request"))
    return certify.audit_problems(rows, o, ["consistent", "wrong"])


def missing_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities that a customer's open orders confirm and none of the finished ones decides."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("key"), "o_orderstatus")
    return certify.missing_approvals(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'")).select("task_id", F.array_join("keys", ",").alias("keys"))


def qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders pass all three gates."""
    o = T.table(spark, sf_dir, "orders")
    gate = lambda name, ok: F.struct(F.lit(name).alias("gate"), ok.alias("passed"))
    gates = o.groupBy(F.col("o_custkey").alias("task_id")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"), F.max((F.col("o_orderstatus") == "P").cast("int")).alias("p"))
    rows = gates.select("task_id", F.inline(F.array(gate("several", F.col("n") > 5), gate("dear", F.col("t") > 1_000_000), gate("no_pending", F.col("p") == 0))))
    return certify.qualification(rows).select("task_id", "qualified", F.array_join("failed", ",").alias("failed"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders of each customer as a list."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("number"), F.concat(F.lit("order "), "o_orderkey").alias("text"), (F.col("o_orderstatus") != "O").alias("closed"))
    return certify.findings(o)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and errors of each user's session."""
    e = T.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(F.col("user_id").alias("session"), F.when(F.col("event_type") == "error", "error").otherwise("use").alias("kind"), k.alias("input"), (k * 2).alias("output"), F.concat(F.lit("e"), k).alias("message"), F.col("event_id").alias("number"))
    return certify.usage(rows).select("session", "input_tokens", "output_tokens", F.array_join("errors", ",").alias("errors"))


def field_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each order that no line has wholly right."""
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("field"), F.round(F.col("l_discount") * 10, 4).alias("score"))
    return certify.field_gaps(rows)


STATES = """b AS (SELECT o_orderkey AS row_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
a AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN 'F' ELSE status END AS status, CASE WHEN row_id % 5 = 0 THEN '1-URGENT' ELSE priority END AS priority FROM b WHERE row_id % 7 <> 0),
d AS (SELECT row_id, 'status' AS "column", b.status AS old, a.status AS new FROM b JOIN a USING (row_id) UNION ALL SELECT row_id, 'priority', b.priority, a.priority FROM b JOIN a USING (row_id))"""

QUERIES = {
    "changed_cells": (changed_cells, f'WITH {STATES} SELECT row_id, "column", old, new FROM d WHERE old <> new'),
    "state_mutations": (state_mutations, f'WITH {STATES} SELECT row_id, "column", new AS now, old AS reverted FROM d WHERE old <> new'),
    "state_changed": (state_changed, f"WITH {STATES} SELECT false AS same, (SELECT count(*) FROM d WHERE old <> new) > 0 OR (SELECT count(*) FROM a) <> (SELECT count(*) FROM b) AS later"),
    "sibling_ids": (
        sibling_ids,
        """WITH r AS (SELECT s_nationkey AS t, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
SELECT r.id, coalesce(array_to_string(list(o.id ORDER BY o.id) FILTER (WHERE o.id IS NOT NULL), ','), '') AS others FROM r LEFT JOIN r o ON o.t = r.t AND o.id <> r.id AND o.k <= 3 + (r.k <= 3)::INT GROUP BY 1""",
    ),
    "skipped_steps": (
        skipped_steps,
        """WITH t AS (SELECT l_orderkey AS e, l_partkey AS p, l_linenumber AS n FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS p, l_returnflag AS flag FROM lineitem)
SELECT e AS episode_id, count(DISTINCT p) AS steps FROM t JOIN f USING (e, p) WHERE flag = 'R' AND n > 1 AND NOT EXISTS (SELECT 1 FROM f x WHERE x.e = t.e AND x.p = t.p AND x.flag <> 'R') GROUP BY 1""",
    ),
    "accepted_results": (
        accepted_results,
        """WITH r AS (SELECT user_id * 100 + (props->>'$.k')::BIGINT AS dataset_index, user_id AS task_id, event_id, ts FROM events WHERE event_type <> 'error')
SELECT dataset_index, task_id, min_by(event_id, ts) AS event_id FROM r WHERE dataset_index % 2 = 0 GROUP BY 1, 2""",
    ),
    "masked_created": (
        masked_created,
        """SELECT 'customer' AS "table", count(*) AS rows, count(*) FILTER (WHERE c_custkey > 50) AS masked_rows, count(*) FILTER (WHERE c_custkey > 50) AS masked_cells FROM customer
UNION ALL SELECT 'supplier', count(*), 0, count(*) FILTER (WHERE s_suppkey > 50 AND s_suppkey IN (SELECT c_custkey FROM customer)) FROM supplier""",
    ),
    "state_shapes": (
        state_shapes,
        """SELECT c_nationkey AS "table", concat_ws(';', CASE WHEN bool_or(c_acctbal > 5000) THEN 'limit,name' END, CASE WHEN bool_or(c_acctbal <= 5000) THEN 'name' END) AS shapes FROM customer GROUP BY 1""",
    ),
    "shape_changes": (shape_changes, """SELECT 'orders' AS "table", o_orderkey AS row_id FROM orders WHERE o_orderkey % 11 = 0"""),
    "overlays": (
        overlays,
        """SELECT o_orderkey AS row_id, 'applied' AS result FROM orders WHERE o_orderkey % 4 = 2 UNION ALL SELECT o_orderkey, 'no such column: color' FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey > 0
UNION ALL SELECT -o_orderkey, 'no such row' FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT 0, 'no such column: color' FROM orders WHERE o_orderkey = 0""",
    ),
    "value_pool": (
        value_pool,
        """WITH v AS (SELECT 'p_brand' AS c, 'string' AS k, p_brand AS v FROM part UNION SELECT 'p_type', 'string', p_type FROM part UNION SELECT 'p_size', 'integer', p_size::VARCHAR FROM part)
SELECT c AS "column", k AS kind, array_to_string(list_sort(list(v))[1:10], ',') AS values FROM v GROUP BY 1, 2""",
    ),
    "approval_flips": (
        approval_flips,
        """WITH f AS (SELECT o_orderkey AS request_id, (o_orderstatus = 'F')::VARCHAR AS s, (o_totalprice > 1000)::VARCHAR AS p, (o_orderstatus <> 'F')::VARCHAR AS ns, (o_totalprice <= 1000)::VARCHAR AS np FROM orders)
SELECT request_id, 'flip:approve_status' AS world, ns AS approve_status, p AS approve_price FROM f UNION ALL SELECT request_id, 'flip:approve_price', s, np FROM f""",
    ),
    "unrepaired": (
        unrepaired,
        """WITH n AS (SELECT user_id AS task_id, event_type AS step, count(*) FILTER (WHERE ts < '2024-01-16') AS a, count(*) FILTER (WHERE ts >= '2024-01-16') AS b FROM events GROUP BY 1, 2)
SELECT task_id, step FROM n WHERE a > 0 AND b < a - CASE WHEN task_id % 3 = 0 AND step = 'error' THEN 1 ELSE 0 END""",
    ),
    "audit_problems": (
        audit_problems,
        """WITH o AS (SELECT o_custkey AS task_id, o_orderkey AS item, CASE WHEN o_orderkey % 10 = 0 THEN 'maybe' WHEN o_orderstatus = 'P' THEN 'wrong' ELSE 'consistent' END AS v FROM orders)
SELECT task_id, item, CASE WHEN item % 9 = 0 THEN 'not covered' WHEN v = 'maybe' THEN 'illegal verdict' ELSE 'no verbatim quote' END AS problem FROM o WHERE item % 9 = 0 OR v = 'maybe' OR (v = 'wrong' AND item % 2 = 1)""",
    ),
    "missing_approvals": (
        missing_approvals,
        """WITH o AS (SELECT DISTINCT o_custkey AS task_id, o_orderpriority AS key, o_orderstatus AS s FROM orders)
SELECT task_id, string_agg(key, ',' ORDER BY key) AS keys FROM o WHERE s = 'O' AND NOT EXISTS (SELECT 1 FROM o x WHERE x.task_id = o.task_id AND x.key = o.key AND x.s = 'F') GROUP BY 1""",
    ),
    "qualification": (
        qualification,
        """WITH g AS (SELECT o_custkey AS task_id, count(*) > 5 AS a, sum(o_totalprice) > 1000000 AS b, NOT bool_or(o_orderstatus = 'P') AS c FROM orders GROUP BY 1)
SELECT task_id, a AND b AND c AS qualified, concat_ws(',', CASE WHEN NOT b THEN 'dear' END, CASE WHEN NOT c THEN 'no_pending' END, CASE WHEN NOT a THEN 'several' END) AS failed FROM g""",
    ),
    "findings": (findings, "SELECT o_custkey AS report_id, coalesce(string_agg('- order ' || o_orderkey, chr(10) ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'O'), '') AS markdown FROM orders GROUP BY 1"),
    "usage": (
        usage,
        """SELECT user_id AS session, sum((props->>'$.k')::INT)::BIGINT AS input_tokens, 2 * sum((props->>'$.k')::INT)::BIGINT AS output_tokens,
coalesce(string_agg('e' || (props->>'$.k'), ',' ORDER BY event_id) FILTER (WHERE event_type = 'error'), '') AS errors FROM events GROUP BY 1""",
    ),
    "field_gaps": (field_gaps, "SELECT l_orderkey AS task_id, l_returnflag AS field, max(round(l_discount * 10, 4)) AS best FROM lineitem GROUP BY 1, 2 HAVING best < 1"),
}
