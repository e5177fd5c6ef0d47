"""Queries on validators: rows of the tables read as requests, schemas, values, groups, segments and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import certify, validators
from tidewright.sources import tables as T


def _joined(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and problems as one text, of the rows that have any."""
    return rows.where(F.size("problems") > 0).select(*keys, F.array_join("problems", ";").alias("problems"))


def request_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: the status is a category, the priority a language."""
    o = T.table(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderkey") % 17 != 0, "Order").otherwise(" ").alias("title"), F.lit("do it").alias("user_request"),
        F.when(F.col("o_orderstatus") == "F", "direct_response").when(F.col("o_orderstatus") == "O", "simple_agentic").otherwise("other").alias("category"),
        F.when(F.col("o_orderkey") % 5 != 0, F.array(F.lit("be kind"))).alias("rules"), F.when(F.col("o_orderpriority") == "5-LOW", "fr").otherwise("en").alias("language"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, "17").when(F.col("o_orderkey") % 2 == 0, "soon").alias("clock"),
    )
    return _joined(validators.requests(rows), "key")


def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers that an order has more than once."""
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("row_id"))
    return validators.duplicate_rows(rows)


def dangling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users who are no customers up to number 100."""
    e = T.table(spark, sf_dir, "events").select(F.lit("c").alias("table"), F.col("user_id").alias("row_id"), "event_id")
    rows = T.table(spark, sf_dir, "customer").where("c_custkey <= 100").select(F.lit("c").alias("table"), F.col("c_custkey").alias("row_id"))
    return validators.dangling_events(e, rows).select("event_id")


def value_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part fields against types that do not always fit."""
    p = T.table(spark, sf_dir, "part")
    none = F.expr("cast(array() as array<string>)")
    leaf = lambda name, type, nullable, enum, value, kind: F.struct(F.lit(name).alias("path"), F.lit(type).alias("type"), F.lit(nullable).alias("nullable"), enum.alias("enum"), value.cast("string").alias("value"), F.lit(kind).alias("json_type"))
    rows = p.select("p_partkey", F.inline(F.array(
        leaf("size", "integer", False, none, F.when(F.col("p_size") % 7 != 0, F.col("p_size")), "number"),
        leaf("price", "integer", True, none, F.round("p_retailprice", 1), "number"),
        leaf("brand", "string", True, F.array(*[F.lit(f"Brand#{a}{b}") for a in range(1, 4) for b in range(1, 6)]), F.col("p_brand"), "string"),
        leaf("name", "number", True, none, F.col("p_name"), "string"),
    )))
    return _joined(validators.values(rows), "p_partkey", "path")


def schema_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as schema leaves: the type's words name the type, the path holds money or not."""
    p = T.table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("string", "integer", "number", "array", "date")]), (F.col("p_size") % 5 + 1).cast("int"))
    path = F.when(F.col("p_partkey") % 2 == 0, "total_price").otherwise("note")
    rows = p.select("p_partkey", path.alias("path"), kind.alias("type"), F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("a"))).alias("enum"), F.when(F.col("p_partkey") % 4 == 0, "any").alias("order"))
    return _joined(validators.schema_leaves(rows), "p_partkey")


def schema_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as schemas whose fields are types: too many fields or values, or nothing graded."""
    p = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("schema_id"), F.concat(F.lit("f"), F.col("p_size") % 7, F.lit("."), F.col("p_size")).alias("path"), (F.col("p_size") > 40).alias("graded"))
    return _joined(validators.schema_size(p), "schema_id")


def key_set_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities that each customer's orders lack of the five, or the other way round."""
    o = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("given"), F.collect_set("o_orderstatus").alias("s"))
    rows = o.select("o_custkey", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("F")).alias("wanted"), F.concat("given", "s").alias("given"))
    return _joined(validators.key_sets(rows, "wanted", "given"), "o_custkey")


def group_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as training groups: orders are episodes, their lines actions."""
    lines = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.array("l_linenumber").alias("prompt"), F.array("l_suppkey").alias("tokens"), F.array((-F.col("l_tax"))).alias("logp"))).alias("actions"))
    o = T.table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    episode = F.struct(
        (F.col("o_orderkey") % 40 == 0).cast("int").alias("seed"), F.when(F.col("o_orderkey") % 31 != 0, F.col("o_totalprice")).alias("reward"), (F.col("o_orderstatus") != "P").alias("terminated"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(1))).alias("bootstrap_prompt"), F.when(F.col("o_orderkey") % 3 == 0, "context_limit").alias("finish_reason"), F.coalesce("actions", F.expr("cast(array() as array<struct<prompt:array<int>,tokens:array<bigint>,logp:array<double>>>)")).alias("actions"),
    )
    groups = o.groupBy("o_custkey").agg(F.collect_list(episode).alias("episodes"))
    rows = groups.select("o_custkey", (2 + F.col("o_custkey") % 3).alias("schema_version"), F.col("o_custkey").alias("task_identity"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("wanted_identity"), F.lit("train").alias("split"), (F.col("o_custkey") % 10 - 1).alias("policy_version"), "episodes")
    return _joined(validators.groups(rows), "o_custkey")


def segment_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as training segments: quantities are tokens, the masks come from the flags."""
    rows = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.col("l_quantity").cast("int")).alias("tokens"), F.collect_list(F.when(F.col("l_linenumber") < 7, -F.col("l_tax"))).alias("logp"), F.collect_list(F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_linenumber") == 6, 2).otherwise(0)).alias("loss_mask")
    )
    return _joined(validators.segments(rows), "l_orderkey")


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a customer's group is not trained on, and what is done about it."""
    o = T.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("kinds"), F.max("o_totalprice").alias("most"))
    reason = validators.admission(empty=F.col("n") < 6, lag=F.col("o_custkey") % 11 - 1, max_lag=8, zero_variance=F.col("kinds") < 3, drift=F.col("most") > 440_000)
    policy = F.element_at(F.array(*[F.lit(x) for x in ("skip", "fail", "retry_skip", "retry_fail")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    rows = o.select("o_custkey", reason.alias("reason"), policy.alias("policy"), (F.col("o_custkey") % 3).alias("attempt"))
    return rows.select("o_custkey", "reason", validators.rejection_action(F.col("reason"), F.col("policy"), F.col("attempt"), 3).alias("action")).where("reason is not null")


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an order, read as a task, is not trained on."""
    k = F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 29 != 0, "done").alias("status"), (k % 23 != 0).alias("training_ready"), F.when(k % 2 == 0, "tests").alias("failure_class"), (k % 6).alias("calls"), F.lit(1).alias("floor"), (k % 5 == 0).alias("wants_image"),
        F.when(k % 10 != 0, "img").alias("image"), F.when(F.col("o_orderstatus") != "P", 4).otherwise(0).alias("policy_k"), F.when(k % 7 == 0, "unsolved").when(k % 7 == 1, "unextractable").when(k % 7 < 5, "passed").when(k % 7 == 5, "broken").alias("gate"), (k % 3).alias("successes"),
    )
    return validators.exclusion(rows).where("reason is not null").select("o_orderkey", "reason")


def simulation_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What explains each order, read as a simulation."""
    k = F.col("o_orderkey")
    out = validators.simulation_outcome(F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5), F.when(k % 6 == 0, "max_steps").when(k % 6 == 1, "user_stop"), F.when(k % 4 != 0, (k % 4 != 1).cast("double")), F.when(k % 3 == 0, 0.0))
    return T.table(spark, sf_dir, "orders").groupBy(out.alias("outcome")).agg(F.count("*").alias("n"))


def rubric_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rubrics: orders are criteria, priorities the quoted basis."""
    o = T.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("rubric_id"), F.col("o_orderpriority").alias("cid"), (F.col("o_orderkey") % 6).alias("weight"), F.substring("o_orderpriority", 1, 6).alias("basis"), F.when(F.col("o_orderkey") % 8 != 0, F.concat(F.lit("It is "), "o_orderpriority")).otherwise("").alias("request"))
    return _joined(validators.rubric(rows), "rubric_id")


def isolation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five pages outside the allowed host, by number."""
    pages = T.table(spark, sf_dir, "pages").select(F.col("page_id").alias("number"), F.col("url").alias("line"))
    return validators.isolation_violations(pages, r"example\.org", r"^https?://")


def tool_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tools: names that read tables, arguments that are objects."""
    p = T.table(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_size") % 4 == 0, "get_rows").when(F.col("p_size") % 4 == 1, "dump_orders").when(F.col("p_size") % 4 == 2, "get_order").otherwise("set_order"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "dict[str, int]").otherwise("str")
    arguments = F.array(F.struct(F.lit("order_id").alias("name"), F.lit("str").alias("type")), F.struct(F.when(F.col("p_partkey") % 5 == 0, "table").otherwise("fields").alias("name"), kind.alias("type")))
    tools = p.select(name.alias("name"), (F.col("p_size") % 4 == 3).alias("write"), arguments.alias("arguments"))
    return certify.tool_problems(tools, ["orders"]).groupBy("tool", "problem").agg(F.count("*").alias("n"))


def policy_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, names and facts that an order's policy text shows."""
    o = T.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Call find_order for "), "o_orderpriority", F.lit(" cases; never tell "), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("clerk "), "o_custkey")).otherwise("anyone"))
    rows = o.select(F.col("o_orderkey").alias("policy_id"), text.alias("text"), F.array(F.lit("cases"), F.lit("case")).alias("names"), F.array(F.concat(F.lit("clerk "), "o_custkey")).alias("facts"))
    return certify.policy_leaks(rows).select("policy_id", F.array_join("leaks", ",").alias("leaks"))


QUERIES = {
    "request_problems": (
        request_problems,
        """WITH p AS (SELECT o_orderkey AS key, concat_ws(';', CASE WHEN o_orderkey % 13 = 0 THEN 'id is missing' END, CASE WHEN o_orderkey % 17 = 0 THEN 'title is missing' END, CASE WHEN o_orderstatus = 'P' THEN 'unknown category' END,
CASE WHEN o_orderkey % 5 = 0 THEN 'no rules' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown language' END, CASE WHEN o_orderkey % 6 = 2 THEN 'bad clock' END) AS problems FROM orders) SELECT * FROM p WHERE problems <> ''""",
    ),
    "duplicate_rows": (duplicate_rows, 'SELECT l_orderkey AS "table", l_linenumber AS row_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING n > 1'),
    "dangling_events": (dangling_events, "SELECT event_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey <= 100)"),
    "value_problems": (
        value_problems,
        """SELECT p_partkey, 'size' AS path, 'null not allowed' AS problems FROM part WHERE p_size % 7 = 0 UNION ALL SELECT p_partkey, 'price', 'wrong type' FROM part WHERE round(p_retailprice, 1) <> floor(round(p_retailprice, 1))
UNION ALL SELECT p_partkey, 'brand', 'not in enum' FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[123][12345]$') UNION ALL SELECT p_partkey, 'name', 'wrong type' FROM part""",
    ),
    "schema_problems": (
        schema_problems,
        """WITH t AS (SELECT p_partkey, ['string', 'integer', 'number', 'array', 'date'][p_size % 5 + 1] AS type FROM part), p AS (SELECT p_partkey, concat_ws(';', CASE WHEN type = 'date' THEN 'unknown type' END,
CASE WHEN p_partkey % 3 = 0 AND type <> 'string' THEN 'enum on another type than string' END, CASE WHEN type = 'array' AND p_partkey % 4 <> 0 THEN 'array without order' END, CASE WHEN type = 'number' AND p_partkey % 2 = 0 THEN 'money must be an integer' END) AS problems FROM t)
SELECT * FROM p WHERE problems <> ''""",
    ),
    "schema_sizes": (
        schema_sizes,
        """WITH g AS (SELECT p_brand AS schema_id, count(DISTINCT p_size % 7) FILTER (WHERE p_size > 40) AS f, count(*) FILTER (WHERE p_size > 40) AS v FROM part GROUP BY 1)
SELECT schema_id, concat_ws(';', CASE WHEN f > 5 THEN 'too many graded fields' END, CASE WHEN v > 8 THEN 'too many graded values' END) AS problems FROM g WHERE f > 5 OR v > 8""",
    ),
    "key_set_problems": (
        key_set_problems,
        """WITH g AS (SELECT o_custkey, list_concat(list(DISTINCT o_orderpriority), list(DISTINCT o_orderstatus)) AS k FROM orders GROUP BY 1),
s AS (SELECT o_custkey, list_sort(list_filter(['1-URGENT', '2-HIGH', 'F'], lambda x: NOT list_contains(k, x))) AS lacking, list_sort(list_filter(k, lambda x: x NOT IN ('1-URGENT', '2-HIGH', 'F'))) AS extra FROM g)
SELECT o_custkey, concat_ws(';', CASE WHEN len(lacking) > 0 THEN 'missing: ' || array_to_string(lacking, ', ') END, CASE WHEN len(extra) > 0 THEN 'unexpected: ' || array_to_string(extra, ', ') END) AS problems FROM s WHERE len(lacking) + len(extra) > 0""",
    ),
    "group_problems": (
        group_problems,
        """WITH l AS (SELECT DISTINCT l_orderkey FROM lineitem), g AS (SELECT o_custkey, bool_or(o_orderkey % 40 = 0) AND bool_or(o_orderkey % 40 <> 0) AS seeds, bool_or(l_orderkey IS NULL AND o_orderkey % 3 <> 0) AS empty,
bool_or(o_orderkey % 31 = 0) AS infinite, bool_or(o_orderstatus = 'P' AND o_orderkey % 2 = 1) AS cut FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT o_custkey, concat_ws(';', CASE WHEN o_custkey % 3 = 2 THEN 'unsupported version' END, CASE WHEN o_custkey % 9 = 0 THEN 'task is absent, changed or not for training' END, CASE WHEN o_custkey % 10 = 0 THEN 'bad policy version' END,
CASE WHEN seeds THEN 'several seeds' END, CASE WHEN empty THEN 'empty episode' END, CASE WHEN infinite THEN 'reward is not finite' END, CASE WHEN cut THEN 'truncated without its next context' END) AS problems FROM g) SELECT * FROM p WHERE problems <> ''""",
    ),
    "segment_problems": (
        segment_problems,
        """WITH g AS (SELECT l_orderkey, bool_or(l_linenumber >= 7) AS a, bool_or(l_linenumber = 6 AND l_returnflag <> 'R') AS m, NOT bool_or(l_returnflag = 'R') AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, concat_ws(';', CASE WHEN a THEN 'not aligned' END, CASE WHEN m THEN 'mask is not 0 or 1' END, CASE WHEN n THEN 'nothing is trained' END) AS problems FROM g WHERE a OR m OR n""",
    ),
    "admissions": (
        admissions,
        """WITH g AS (SELECT o_custkey, CASE WHEN count(*) < 6 THEN 'empty_actions' WHEN o_custkey % 11 - 1 < 0 OR o_custkey % 11 - 1 > 8 THEN 'policy_age' WHEN count(DISTINCT o_orderstatus) < 3 THEN 'zero_reward_variance' WHEN max(o_totalprice) > 440000 THEN 'importance_drift' END AS reason FROM orders GROUP BY 1)
SELECT o_custkey, reason, CASE WHEN reason = 'zero_reward_variance' AND o_custkey % 4 < 2 THEN CASE WHEN o_custkey % 4 = 0 THEN 'skip' ELSE 'fail' END WHEN o_custkey % 3 + 1 < 3 THEN 'retry'
WHEN reason = 'zero_reward_variance' AND o_custkey % 4 = 2 THEN 'skip' ELSE 'fail' END AS action FROM g WHERE reason IS NOT NULL""",
    ),
    "exclusions": (
        exclusions,
        """WITH r AS (SELECT o_orderkey, o_orderkey AS k, CASE WHEN o_orderkey % 29 = 0 THEN 'not built' WHEN o_orderkey % 23 = 0 THEN 'build failed: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'tests' ELSE 'unknown' END WHEN o_orderkey % 6 < 1 THEN 'too easy'
WHEN o_orderkey % 10 = 0 THEN 'image not verified' WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 7 = 0 THEN 'policy gate: unsolved' WHEN o_orderkey % 7 = 1 AND o_orderkey % 3 = 0 THEN 'policy gate: unreadable'
WHEN o_orderkey % 7 = 5 THEN 'policy gate not passed: broken' WHEN o_orderkey % 7 = 6 THEN 'policy gate not passed: not run' END AS reason FROM orders) SELECT o_orderkey, reason FROM r WHERE reason IS NOT NULL""",
    ),
    "simulation_outcomes": (
        simulation_outcomes,
        """SELECT CASE WHEN o_orderstatus = 'F' THEN 'pass' WHEN o_orderkey % 6 = 0 THEN 'max_steps' WHEN o_orderkey % 4 = 1 THEN 'db' WHEN o_orderkey % 3 = 0 THEN 'communicate' ELSE 'nl' END AS outcome, count(*) AS n FROM orders GROUP BY 1""",
    ),
    "rubric_problems": (
        rubric_problems,
        """WITH g AS (SELECT o_custkey AS rubric_id, count(*) AS n, count(DISTINCT o_orderpriority) AS d, bool_or(o_orderkey % 6 = 0) AS w, bool_or(o_orderkey % 8 = 0) AS q FROM orders GROUP BY 1)
SELECT rubric_id, concat_ws(';', CASE WHEN n < 3 OR n > 6 THEN 'not 3 to 6 criteria' END, CASE WHEN n <> d THEN 'repeated criterion' END, CASE WHEN w THEN 'weight not 1 to 5' END, CASE WHEN q THEN 'basis is not quoted' END) AS problems FROM g WHERE n < 3 OR n > 6 OR n <> d OR w OR q""",
    ),
    "isolation_report": (isolation_report, r"SELECT page_id AS number, url AS line FROM pages WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(url, 'example\.org') ORDER BY page_id LIMIT 5"),
    "tool_problems": (
        tool_problems,
        """WITH t AS (SELECT ['get_rows', 'dump_orders', 'get_order', 'set_order'][p_size % 4 + 1] AS tool, p_size % 4 AS k, p_partkey FROM part)
SELECT tool, 'a generic table reader' AS problem, count(*) AS n FROM t WHERE k < 2 OR p_partkey % 5 = 0 GROUP BY 1
UNION ALL SELECT tool, 'argument ' || CASE WHEN p_partkey % 5 = 0 THEN 'table' ELSE 'fields' END || ' is an object', count(*) FROM t WHERE k = 3 AND p_partkey % 2 = 0 GROUP BY 1, 2""",
    ),
    "policy_leaks": (
        policy_leaks,
        """SELECT o_orderkey AS policy_id, 'cases' || CASE WHEN o_orderkey % 3 = 0 THEN ',clerk ' || o_custkey ELSE '' END || ',find_order' AS leaks FROM orders""",
    ),
}
