"""Queries on scripts and scenes, task plans and manifests, perturbations and outcome shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import planning, scripts
from tidewright.sources import tables as T

ELEMENTS = "fallback pushback multi_goal out_of_scope wrong_first inquisitive change_of_mind ambiguous clarify identity forgotten".split()
SCRIPT = (
    '{"traits": ["calm"], "fallbacks": ["a", "b"], "pushback": {"demand": "d", "rounds": 2, "then": "accept"}, "goals": ["one", "two"], "out_of_scope": "two", "wrong_first": {"order_id": "V#"}, "inquisitive": ["why"],'
    ' "change_of_mind": {"from": "a", "to": "b", "after": "c"}, "ambiguous": {"phrase": "that one", "fact": "order_id"}, "clarify": {"options": ["a", "b"], "decides_by": "price"}, "forgotten": ["email"]}'
)
#: By element what to break in the script (the last but one in the scene) and the problem that follows.
BROKEN = {
    "fallback": ('["a", "b"], "pushback"', '["a"], "pushback"', "two options or more, with an approval each"),
    "pushback": ('"rounds": 2', '"rounds": 4', "a demand, one to three rounds, and acceptance"),
    "multi_goal": ('["one", "two"]', '["two"]', "two goals or more"),
    "out_of_scope": ('"out_of_scope": "two"', '"out_of_scope": "three"', "a request that is also a goal"),
    "wrong_first": ('"V#"', '"W#"', "the wrong value must differ and stand nowhere"),
    "inquisitive": ('["why"]', "[]", "a list of questions"),
    "change_of_mind": ('"from": "a"', '"from": ""', "from, to and after, with an approval each"),
    "ambiguous": ('"fact": "order_id"', '"fact": "nothing"', "a phrase and a known fact"),
    "clarify": ('"options": ["a", "b"]', '"options": ["a"]', "two or three options, what decides, and an approval each"),
    "identity": ('"name": "x"', '"name": "W#"', "an identifier that the opening does not reveal"),
    "forgotten": ('["email"]', '["order_id"]', "what is forgotten must be known nowhere"),
}


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests with one script element each, in turn, every other one broken; some without script, elements or traits, some that tell too much."""
    k = F.col("o_orderkey")
    bad = F.floor(k / 11) % 2 == 1
    pick = lambda i: F.get(F.array(*[F.lit(BROKEN[e][i]) for e in ELEMENTS]), (k % 11).cast("int"))
    numbered = lambda c: F.replace(c, F.lit("#"), k.cast("string"))
    broken = lambda text: numbered(F.when(bad, F.replace(F.lit(text) if isinstance(text, str) else text, pick(0), pick(1))).otherwise(text))
    script = F.when(k % 13 != 0, broken(F.when(k % 19 == 0, SCRIPT.replace('["calm"]', "[]")).otherwise(SCRIPT)))
    scene = '{"situation": "s", "goal": "g", "known": {"name": "x"}, "wants_to_know": []}'
    element = F.get(F.array(*[F.lit(e) for e in ELEMENTS]), (k % 11).cast("int"))
    return T.table(spark, sf_dir, "orders").select(
        k.alias("request_id"), F.when(k % 17 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(element)).alias("elements"), script.alias("script"),
        numbered(F.lit('{"approve_a": true, "approve_b": false, "order_id": "W#"}')).alias("facts"), broken(F.when(k % 23 == 0, scene.replace('"x"', '"x", "city": "y", "age": 3')).otherwise(scene)).alias("scene"), numbered(F.lit('{"orders": [{"id": "W#"}]}')).alias("tables"),
    )


def script_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of the scripts of all requests."""
    return scripts.script_problems(_requests(spark, sf_dir)).select("request_id", F.array_join("problems", "|").alias("problems"))


def _scene(k: Column) -> Column:
    return F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "[1]").when(k % 7 == 2, '{"goal": " ", "known": [], "wants_to_know": 3}').otherwise(
        F.concat(F.lit('{"situation": "at 7", "goal": "g", "known": {"a 1": '), k, F.lit(', "b": [-1.5, {"c": "2", "d": 1e3}]}, "wants_to_know": ['), F.array_join(F.array_repeat(F.lit("1"), (k % 7).cast("int") - 2), ", "), F.lit("]}"))
    )


def scene_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of scenes, and the numbers of what they tell."""
    k = F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select(k, _scene(k).alias("scene"))
    numbers = scripts.numbers_of(F.get_json_object("scene", "$.known"))
    return rows.select("o_orderkey", F.array_join(scripts.scene_problems(F.col("scene")), "|").alias("problems"), F.size(numbers).alias("numbers"), F.round(F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def request_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of whole requests: of the scene, of the shape, of the rest."""
    k = F.col("request_id")
    shape = F.get(F.array(*[F.lit(s) for s in ("direct", "single_write", "complex", "subjective", "simple")]), (k % 5).cast("int"))
    facts = F.concat(F.lit('{"id": "W"'), F.when(k % 3 > 0, ', "approve_a": true').otherwise(""), F.when(k % 3 > 1, ', "approve_b": 1').otherwise(""), F.lit("}"))
    rows = _requests(spark, sf_dir).withColumns({
        "elements": F.expr("cast(array() as array<string>)"), "shape": shape, "facts": facts, "scene": F.when(k % 29 == 0, "null").otherwise(_scene(k * 7 + 3)), "tables": F.when(k % 2 == 0, '{"a": []}').otherwise('{"a": [{"id": 1}]}'),
        "category": F.when(k % 31 == 0, "x").otherwise("y"), "wanted_category": F.lit("y"), "reward_type": F.when(k % 4 == 0, "rubric"), "language": F.when(k % 37 == 0, "en"), "wanted_language": F.lit(None).cast("string"),
    })
    return scripts.request_problems(rows).select("request_id", F.array_join("problems", "|").alias("problems"))


def task_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as processes of their nations, which have as many tasks as their number and twenty."""
    s = T.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    processes = s.select(F.col("s_nationkey").alias("world"), F.concat(F.lit("p"), k).alias("process"), F.when(k % 4 == 0, "inquiry").when(k % 4 == 1, "advice").otherwise("account").alias("kind"), F.when(k % 3 == 0, "approve_x").alias("approval"))
    counts = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("world"), (F.col("n_nationkey") + 20).alias("tasks"))
    return planning.task_plan(processes, counts).select("world", "place", F.coalesce("shape", F.lit("")).alias("shape"), F.array_join("processes", ",").alias("processes"))


def task_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks on their customers' worlds."""
    o, c = T.table(spark, sf_dir, "orders"), T.table(spark, sf_dir, "customer")
    k, w = F.col("o_orderkey"), F.col("c_custkey")
    tasks = o.select(F.concat(F.lit("w-t"), "o_custkey", F.lit("-t"), k).alias("task_id"), (k % 4 > 0).alias("passed"), F.lit("gates").alias("stage"), F.col("o_orderpriority").alias("problems"))
    name = F.concat(F.lit("w-t"), w)
    worlds = c.select(F.when(w % 5 == 0, F.concat(F.lit("z"), w)).otherwise(name).alias("world"), F.when(w % 5 == 0, name).alias("id"), (F.col("c_acctbal") > 0).alias("ready"))
    images = worlds.select("world", F.substring_index("world", "t", -1).alias("n")).select("world", F.expr("try_cast(regexp_replace(n, 'z', '') as bigint)").alias("n")).where("n % 3 > 0").select("world", F.when(F.col("n") % 7 == 0, "failed").alias("error"))
    policies = o.where(k % 5 < 2).select(F.concat(F.lit("w-t"), "o_custkey", F.lit("-t"), k).alias("task_id"), F.when(k % 5 == 0, "failed").otherwise("passed").alias("verdict"))
    out = planning.task_manifest(tasks, worlds, images, policies, 12)
    return out.select("task_id", F.coalesce("split", F.lit("")).alias("split"), F.coalesce("reason", F.lit("")).alias("reason"))


def insensitive_worlds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as perturbed worlds of their customers, lines as changed cells."""
    o = T.table(spark, sf_dir, "orders")
    k, line = F.col("o_orderkey"), F.col("l_linenumber")
    world = F.concat(F.lit("perturb-"), k).alias("world")
    cells = T.table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == k).select(
        F.col("o_custkey").alias("task_id"), world, F.col("l_quantity").cast("string").alias("original"), F.when(line == 1, "0").when(line != 2, "7").alias("perturbed"), F.when(line == 3, "boolean").otherwise("integer").alias("kind"), (F.col("l_returnflag") != "R").alias("touched")
    )
    runs = o.select(F.col("o_custkey").alias("task_id"), world, k.alias("number"), F.when(k % 9 > 0, F.col("o_orderstatus")).alias("outcome"))
    runs = runs.unionByName(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.lit("original").alias("world"), F.lit(0).cast("long").alias("number"), F.lit("F").alias("outcome")))
    return planning.insensitive_worlds(cells, runs, o.where(k % 10 == 1).select(F.col("o_custkey").alias("task_id"), world), 3)


def outcome_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as processes of worlds, their outcomes by their numbers."""
    k = F.col("p_partkey")
    prop = lambda name, enums: F.struct(F.lit(name).alias("name"), F.lit("string").alias("type"), F.lit(enums).alias("enums"))
    properties = F.when(k % 4 == 0, F.array(prop("recommended", 2), prop("reason", 2))).when(k % 4 == 1, F.array(prop("reason", 0))).when(k % 4 == 2, F.array(prop("choice", 0), prop("x", 1))).otherwise(F.array(prop("reason_code", 3)))
    kind = F.get(F.array(*[F.lit(x) for x in ("inquiry", "advice", "account", "other", "account")]), (k % 5).cast("int"))
    rows = T.table(spark, sf_dir, "part").select((k % 61).alias("world"), F.concat(F.lit("p"), k).alias("process"), kind.alias("kind"), F.when(k % 7 > 0, "object").alias("type"), F.when(k % 3 == 0, "approve_x").when(k % 3 == 1, "ok").alias("approval"), properties.alias("properties"))
    return planning.outcome_problems(rows)


def _case(i: int) -> str:
    return "CASE k % 11 " + " ".join(f"WHEN {n} THEN '{e}: {BROKEN[e][i]}'" for n, e in enumerate(ELEMENTS)) + " END"


SHAPES = ", ".join(f"('{s}', {share}::DOUBLE, {n})" for n, (s, share) in enumerate(planning.WORLD_MIX.items()))

QUERIES = {
    "script_rules": (
        script_rules,
        f"""WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS request_id, CASE WHEN k % 17 = 0 THEN '' WHEN k % 13 = 0 THEN 'script is missing' ELSE concat_ws('|', CASE WHEN k % 19 = 0 THEN 'traits: a list of traits' END,
CASE WHEN k // 11 % 2 = 1 THEN {_case(2)} END, CASE WHEN k % 23 = 0 THEN 'known: more than 2 items' END) END AS problems FROM o""",
    ),
    "scene_rules": (
        scene_rules,
        """WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS k FROM orders) SELECT o_orderkey, CASE WHEN k < 2 THEN 'scene is missing' WHEN k = 2 THEN 'situation must be a text|goal must be a text|known must be an object|wants_to_know must be a list' WHEN k = 6 THEN 'more than 3 wishes' ELSE '' END AS problems,
CASE WHEN k > 2 THEN 3 ELSE 0 END AS numbers, CASE WHEN k > 2 THEN o_orderkey + 998.5 ELSE 0 END::DOUBLE AS total FROM o""",
    ),
    "request_rules": (
        request_rules,
        """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS s, o_orderkey % 3 AS a FROM orders) SELECT k AS request_id, CASE WHEN k % 29 = 0 THEN 'scene is missing' ELSE concat_ws('|', CASE WHEN a = 2 THEN 'an approval is no truth' END, CASE WHEN k % 37 = 0 THEN 'another language' END,
CASE WHEN k % 31 = 0 THEN 'another category' END, CASE WHEN (k % 4 = 0) <> (s = 3) THEN 'another reward' END, CASE WHEN s = 1 AND a = 0 THEN 'a single write needs an approval' END, CASE WHEN s = 2 AND a < 2 THEN 'a complex task needs two approvals' END,
CASE WHEN s = 0 AND k % 2 = 1 THEN 'a direct task needs no rows' END) END AS problems FROM o""",
    ),
    "task_plan": (
        task_plan,
        f"""WITH p AS (SELECT s_nationkey AS world, 'p' || s_suppkey AS process, s_suppkey % 4 AS kind, s_suppkey % 3 = 0 AS writes FROM supplier),
g AS (SELECT world, list_sort(list(process)) AS names, coalesce(list_sort(list(process) FILTER (WHERE kind = 0)), []) AS i, coalesce(list_sort(list(process) FILTER (WHERE kind = 1)), []) AS a, coalesce(list_sort(list(process) FILTER (WHERE kind > 1)), []) AS c,
coalesce(list(process) FILTER (WHERE writes), []) AS w FROM p GROUP BY 1), h AS (SELECT *, CASE WHEN len(c) = 0 THEN names ELSE c END AS accounts FROM g),
q AS (SELECT *, list_filter(accounts, lambda x: list_contains(w, x)) AS wr, list_filter(accounts, lambda x: NOT list_contains(w, x)) AS rd, n_nationkey + 20 AS tasks, least(n_nationkey + 20, len(names)) AS probes FROM h JOIN nation ON n_nationkey = world),
m(shape, share, o) AS (VALUES {SHAPES}), f AS (SELECT world, shape, o, j FROM q, m, range(100) r(j) WHERE j < round_even((tasks - probes) * share, 0) UNION ALL SELECT world, 'single_write', 9, j FROM q, range(100) r(j) WHERE j < tasks - probes),
n AS (SELECT f.world, shape, row_number() OVER (PARTITION BY f.world ORDER BY o, j) - 1 AS k FROM f), t AS (SELECT n.*, q.* EXCLUDE (world) FROM n JOIN q USING (world) WHERE k < tasks - probes),
z AS (SELECT *, probes + row_number() OVER (PARTITION BY world ORDER BY sha256('0:plan:' || world || ':' || k), k) - 1 AS place,
CASE shape WHEN 'direct' THEN i WHEN 'subjective' THEN a WHEN 'single_write' THEN wr WHEN 'complex' THEN wr ELSE rd END AS own FROM t), y AS (SELECT *, CASE WHEN len(own) = 0 THEN accounts ELSE own END AS pool FROM z)
SELECT world, (k - 1)::INT AS place, CASE WHEN list_contains(i, process) THEN 'direct' WHEN list_contains(a, process) THEN 'subjective' ELSE '' END AS shape, process AS processes FROM (SELECT *, unnest(names) AS process, generate_subscripts(names, 1) AS k FROM q) WHERE k <= probes
UNION ALL SELECT world, place::INT, shape, pool[place % len(pool) + 1] || CASE WHEN shape <> 'direct' AND len(pool) > 1 AND ('0x' || substr(sha256('0:second:' || world || ':' || place), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3::DOUBLE
THEN ',' || pool[(place + 1 + ('0x' || substr(sha256('0:other:' || world || ':' || place), 1, 8))::BIGINT % (len(pool) - 1)) % len(pool) + 1] ELSE '' END FROM y""",
    ),
    "task_manifest": (
        task_manifest,
        """WITH w AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 5 = 0 THEN 'z' || c_custkey ELSE 'w-t' || c_custkey END AS world, c_acctbal > 0 AS ready FROM customer),
h AS (SELECT *, ready AND row_number() OVER (PARTITION BY ready ORDER BY world DESC) <= 12 AS held FROM w),
t AS (SELECT 'w-t' || o_custkey || '-t' || o_orderkey AS task_id, held, CASE WHEN o_orderkey % 4 = 0 THEN 'gates: ' || o_orderpriority WHEN c % 3 = 0 OR c % 7 = 0 THEN 'no verified image' WHEN o_orderkey % 5 = 0 THEN 'policy gate failed' ELSE '' END AS reason FROM orders JOIN h ON c = o_custkey)
SELECT task_id, CASE WHEN reason <> '' THEN '' WHEN held THEN 'eval' ELSE 'train' END AS split, reason FROM t""",
    ),
    "insensitive_worlds": (
        insensitive_worlds,
        """WITH c AS (SELECT l_orderkey AS k, count(*) FILTER (WHERE l_linenumber <= 3) AS weight FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
r AS (SELECT o_custkey AS task_id, 'perturb-' || k AS world, weight, row_number() OVER (PARTITION BY o_custkey ORDER BY weight DESC, k) AS place FROM c JOIN orders ON o_orderkey = k WHERE k % 10 <> 1 AND k % 9 > 0 AND o_orderstatus = 'F')
SELECT task_id, place::INT AS place, world, weight FROM r WHERE place <= 3""",
    ),
    "outcome_rules": (
        outcome_rules,
        """WITH p AS (SELECT p_partkey % 61 AS world, p_partkey AS k, p_partkey % 5 AS kind, p_partkey % 7 > 0 AS shaped FROM part), g AS (SELECT world, count(*) FILTER (WHERE kind = 1) AS a, count(*) FILTER (WHERE kind = 0) AS i FROM p GROUP BY 1)
SELECT world, 'p' || k AS process, 'unknown kind' AS problem FROM p WHERE kind = 3 UNION ALL SELECT world, 'p' || k, 'the outcome is no object' FROM p WHERE NOT shaped UNION ALL SELECT world, 'p' || k, 'the approval is no pattern' FROM p WHERE shaped AND k % 3 = 1
UNION ALL SELECT world, 'p' || k, 'advice without recommendation and reasons' FROM p WHERE shaped AND kind = 1 AND k % 4 > 0 UNION ALL SELECT world, 'p' || k, 'an account without a reason' FROM p WHERE shaped AND kind IN (2, 4) AND k % 4 IN (1, 2)
UNION ALL SELECT world, '', 'no advice' FROM g WHERE a = 0 UNION ALL SELECT world, '', 'not one or two inquiries' FROM g WHERE i NOT BETWEEN 1 AND 2""",
    ),
}
