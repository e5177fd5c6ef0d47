"""Queries on nested answers, refusals and cascades of denials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import contracts, grading
from tidewright.sources import tables as T
from tidewright.sources.shared import tasks_for

SCHEMA = {
    "fields": {
        "status": {"type": "string", "enum": ["F", "O", "P"]},
        "ship": {"type": "object", "properties": {"priority": {"type": "string"}, "clerk": {"type": "string", "nullable": True}, "open": {"type": "boolean"}, "note": {"type": "string", "graded": False}}},
        "lines": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer"}, "q": {"type": "integer"}}}},
        "tags": {"type": "array", "order": "any", "items": {"type": "string"}},
    }
}


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as expected and actual answers (JSON): the actual ones differ by rules of their numbers."""
    k = F.col("o_orderkey")
    lines = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"))
    held = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("n"), "q"))).alias("lines"))
    o = T.table(spark, sf_dir, "orders").join(held, k == F.col("l_orderkey"))
    ship = lambda priority, clerk, opened: F.struct(priority.alias("priority"), clerk.alias("clerk"), opened.alias("open"), k.cast("string").alias("note"))
    clerk = F.when(k % 10 > 0, F.concat(F.lit("clerk "), k % 9))
    tags = F.array(F.concat(F.lit("t"), k % 3), F.concat(F.lit("u"), k % 4), F.lit("v"))
    wrong = F.transform("lines", lambda x: F.struct(x["n"].alias("n"), F.when((k + x["n"]) % 4 == 0, x["q"] + 1).otherwise(x["q"]).alias("q")))
    wrong = F.when(k % 6 == 0, F.slice(wrong, F.lit(1), F.size("lines") - 1)).otherwise(wrong)
    opened = k % 2 == 0
    actual = F.struct(
        F.when(k % 7 == 0, "x").otherwise(F.col("o_orderstatus")).alias("status"),
        ship(F.when(k % 3 == 0, "LOW").otherwise(F.upper("o_orderpriority")), F.when(k % 5 == 1, "somebody").otherwise(clerk), F.when(k % 8 == 0, ~opened).otherwise(opened)).alias("ship"),
        wrong.alias("lines"), F.when(k % 9 == 0, F.array(F.lit("v"), F.lit("v"), F.lit("t0"))).otherwise(F.reverse(tags)).alias("tags"),
    )
    expected = F.struct(F.col("o_orderstatus").alias("status"), ship(F.col("o_orderpriority"), clerk, opened).alias("ship"), F.col("lines"), tags.alias("tags"))
    json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    return o.select("o_orderkey", json(expected).alias("expected"), F.when(k % 11 == 0, "[]").otherwise(json(actual)).alias("actual"))


def nested_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial credit of every order's nested answer, by field."""
    out = grading.deep_scores(_answers(spark, sf_dir), SCHEMA)
    return out.select("o_orderkey", *[F.round(F.try_element_at("scores", F.lit(f)), 6).alias(f) for f in SCHEMA["fields"]])


def nested_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps every order's answer from the schema, also those whose status, line numbers or keys are made wrong."""
    k = F.col("o_orderkey")
    broken = F.when(k % 4 == 0, F.regexp_replace("expected", '"status":"."', '"status":"Z"')).when(k % 4 == 1, F.replace("expected", F.lit('"n":1,'), F.lit('"n":"1",'))).when(k % 4 == 2, F.replace("expected", F.lit('"tags"'), F.lit('"labels"'))).otherwise(F.replace("expected", F.lit('"open":'), F.lit('"open":0, "x":')))
    rows = _answers(spark, sf_dir).select("o_orderkey", F.when(k % 13 == 0, "no json").otherwise(broken).alias("answer"))
    return grading.answer_problems(rows, SCHEMA).select("o_orderkey", F.array_join("problems", "|").alias("problems"))


def nested_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graded leaves of the expected answers: how many there are of each kind of path, and how many are null."""
    leaves = grading.answer_leaves(_answers(spark, sf_dir).select("o_orderkey", F.col("expected").alias("answer")), SCHEMA)
    path = F.regexp_replace("path", r"\[[0-9]+\]", "[]")
    return leaves.groupBy(path.alias("path")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") == "null", 1)).alias("nulls"))


def silent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer that says nothing earns, by field."""
    rows = grading.silenced(_answers(spark, sf_dir).select("o_orderkey", "expected"), SCHEMA, "expected")
    out = grading.deep_scores(rows, SCHEMA, actual="silent")
    return out.agg(F.count("*").alias("n"), *[F.round(F.sum(F.try_element_at("scores", F.lit(f))), 6).alias(f) for f in SCHEMA["fields"]])


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks whose expected state is the initial one: no line was returned."""
    k = F.col("o_orderkey")
    tasks = T.table(spark, sf_dir, "orders").select(k.alias("task_id"), F.when(k % 3 == 0, "single_write").when(k % 3 == 1, "complex").otherwise("simple").alias("shape"))
    changes = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("changes"))
    return contracts.refusals(tasks, changes)


def cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: the original takes a confirmation and a tool a line; with line 2 denied, the lines after it with an odd sum go."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    read = T.table(spark, sf_dir, "lineitem").select(k, n)
    lines = read.repartition(tasks_for(read), k).distinct()
    confirm, tool = F.concat(F.lit("confirm a"), n), F.concat(F.lit("tool"), n % 3)
    step = lambda world, name: F.struct(F.lit(world).alias("world"), name.alias("step"))
    denied = F.when((n < 3) | ((k + n) % 2 == 0), F.array(step("flip:a2", confirm), step("flip:a2", tool))).otherwise(F.expr("cast(array() as array<struct<world:string,step:string>>)"))
    each = F.concat(F.array(step("original", confirm), step("original", tool), step("flip:a9", F.lit("tool0"))), denied)
    steps = lines.select(k.alias("task_id"), F.inline(each)).groupBy("task_id", "world", "step").agg(F.count("*").alias("n"))
    out = contracts.cascades(steps)
    return out.select("task_id", "world", F.array_join("approvals", ",").alias("approvals"), F.array_join("steps", ",").alias("steps"))


LINES = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity)::INT AS q FROM lineitem GROUP BY 1, 2)"

QUERIES = {
    "nested_scores": (
        nested_scores,
        f"""WITH {LINES}, s AS (SELECT k, avg(CASE WHEN (k + n) % 4 = 0 THEN 0.5 ELSE 1 END)::DOUBLE AS lines FROM l GROUP BY 1),
o AS (SELECT o_orderkey AS k, lines, o_orderkey % 11 > 0 AS whole, (o_orderkey % 3 > 0)::INT AS p, (o_orderkey % 5 <> 1)::INT AS c, o_orderkey % 10 = 0 AS unset, o_orderkey % 8 > 0 AS open FROM orders JOIN s ON k = o_orderkey),
g AS (SELECT *, CASE WHEN p = 1 AND c = 1 AND open THEN 1 WHEN unset THEN p * CASE WHEN open THEN 1 ELSE 0.5 END ELSE (p + c) / 2.0 * CASE WHEN open THEN 1 ELSE 0.5 END END::DOUBLE AS ship FROM o)
SELECT k AS o_orderkey, CASE WHEN whole AND k % 7 > 0 THEN 1 ELSE 0 END::DOUBLE AS status, CASE WHEN whole THEN round(ship, 6) ELSE 0 END AS ship, CASE WHEN whole AND k % 6 > 0 THEN round(lines, 6) ELSE 0 END AS lines, CASE WHEN whole AND k % 9 > 0 THEN 1 ELSE 0 END::DOUBLE AS tags FROM g""",
    ),
    "nested_problems": (
        nested_problems,
        f"""WITH {LINES}, f AS (SELECT k, min(n) AS n FROM l GROUP BY 1) SELECT k AS o_orderkey, CASE WHEN k % 13 = 0 THEN 'answer: null not allowed' WHEN k % 4 = 0 THEN 'answer.status: ''Z'' not in enum' WHEN k % 4 = 1 THEN CASE WHEN n = 1 THEN 'answer.lines[0].n: expected integer' ELSE '' END
WHEN k % 4 = 2 THEN 'answer: keys [''labels'', ''lines'', ''ship'', ''status''] != [''lines'', ''ship'', ''status'', ''tags'']' ELSE 'answer.ship: keys [''clerk'', ''note'', ''open'', ''priority'', ''x''] != [''clerk'', ''note'', ''open'', ''priority'']|answer.ship.open: expected boolean' END AS problems FROM orders JOIN f ON k = o_orderkey""",
    ),
    "nested_leaves": (
        nested_leaves,
        f"""WITH {LINES}, n AS (SELECT count(DISTINCT k) AS o, count(*) AS l, count(DISTINCT k) FILTER (WHERE k % 10 = 0) AS z FROM l)
SELECT unnest(['status', 'ship.priority', 'ship.clerk', 'ship.open', 'lines', 'lines[].n', 'lines[].q', 'tags']) AS path, unnest([o, o, o, o, o, l, l, o]) AS n, unnest([0, 0, z, 0, 0, 0, 0, 0]) AS nulls FROM n""",
    ),
    "silent_scores": (
        silent_scores,
        f"""WITH {LINES}, n AS (SELECT count(DISTINCT k) AS n FROM l) SELECT n, 0.0::DOUBLE AS status, 0.0::DOUBLE AS ship, 0.0::DOUBLE AS lines, 0.0::DOUBLE AS tags FROM n""",
    ),
    "refusals": (
        refusals,
        "SELECT o_orderkey AS task_id, CASE o_orderkey % 3 WHEN 0 THEN 'single_write' ELSE 'complex' END AS shape FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    ),
    "cascades": (
        cascades,
        """WITH l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), s AS (SELECT k, n, NOT (n < 3 OR (k + n) % 2 = 0) AS gone, unnest(['confirm a' || n, 'tool' || n % 3]) AS step FROM l),
g AS (SELECT k, step FROM s WHERE k IN (SELECT k FROM l WHERE n = 2) AND step <> 'confirm a2' GROUP BY 1, 2 HAVING bool_or(gone))
SELECT k AS task_id, 'flip:a2' AS world, coalesce(string_agg(substr(step, 9), ',' ORDER BY substr(step, 9)) FILTER (WHERE starts_with(step, 'confirm ')), '') AS approvals, string_agg(step, ',' ORDER BY step) AS steps FROM g GROUP BY 1""",
    ),
}
