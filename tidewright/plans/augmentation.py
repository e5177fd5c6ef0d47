"""Queries on augmented episodes: greetings, layouts, results, names, example values and injected errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import augment
from tidewright.sources import tables as T

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,name:string,context_only:boolean>"
SYSTEM = "Be kind. Use get_order first.\n\nPolicy:\nNo refunds.\n\nCurrent time: 1"
TOOLS = ("get_order", "find_order", "cancel_order")


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as episodes: a user names the even orders, one in four in Chinese; each order is looked up or cancelled and has a result."""
    held = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).alias("o"))
    id = lambda x: F.concat(F.lit("W"), x["k"])
    no_calls = F.expr("cast(null as array<struct<id:string,name:string,arguments:string>>)")
    null, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    message = lambda role, content, calls=no_calls, call_id=null, name=null: F.struct(F.lit(role).alias("role"), content.alias("content"), calls.alias("tool_calls"), call_id.alias("tool_call_id"), name.alias("name"), no.alias("context_only"))
    told = F.array_join(F.transform(F.filter("o", lambda x: x["k"] % 2 == 0), id), ", ")
    asked = F.concat(F.when(F.col("episode_id") % 4 == 0, "请查 ").otherwise("Look up "), told)
    tool = lambda x: F.get(F.array(*[F.lit(t) for t in TOOLS]), (x["k"] % 3).cast("int"))
    call = lambda x: F.array(F.struct(F.concat(F.lit("c"), x["k"]).alias("id"), tool(x).alias("name"), F.concat(F.lit('{"order_id": "'), id(x), F.lit('"}')).alias("arguments")))
    result = lambda x: F.when(x["k"] % 5 > 0, F.concat(F.lit('{"ok": true, "result": "'), x["s"], F.lit('"}'))).otherwise('{"ok": false, "error": "late"}')
    turns = F.flatten(F.transform("o", lambda x: F.array(message("assistant", F.lit(""), call(x)), message("tool", result(x), call_id=F.concat(F.lit("c"), x["k"]), name=tool(x)))))
    whole = F.concat(F.array(message("system", F.lit(SYSTEM)), message("user", asked)), turns, F.array(message("assistant", F.lit("Done."))))
    return held.select("episode_id", whole.cast(f"array<{MESSAGE}>").alias("messages"))


def greeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first roles and the greeting of every episode."""
    out = augment.greet(_episodes(spark, sf_dir), seed=2)
    return out.select("episode_id", F.array_join(F.transform(F.slice("messages", 1, 3), lambda m: m["role"]), ",").alias("roles"), F.get("messages", 1)["content"].alias("greeting"))


def relaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system prompt of every episode in a drawn layout."""
    return augment.relayout(_episodes(spark, sf_dir), seed=2).select("episode_id", F.get("messages", 0)["content"].alias("system"))


def varied_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of every episode in its style."""
    out = augment.vary_results(_episodes(spark, sf_dir), seed=2)
    tools = F.filter("messages", lambda m: m["role"] == "tool")
    return out.select("episode_id", F.array_join(F.transform(tools, lambda m: m["content"]), "|").alias("results"))


def renamed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools that every episode calls, and its prompt, under new names."""
    out = augment.rename_tools(_episodes(spark, sf_dir), seed=2)
    names = F.flatten(F.transform("messages", lambda m: F.coalesce(F.transform(m["tool_calls"], lambda c: c["name"]), F.expr("cast(array() as array<string>)"))))
    return out.select("episode_id", F.array_join(names, ",").alias("tools"), F.substring_index(F.get("messages", 0)["content"], "\n", 1).alias("prompt"))


def example_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up order numbers for the tools of every episode."""
    return augment.example_values(_episodes(spark, sf_dir), seed=2)


def injected_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every episode's two injected errors stand at most, with which arguments, and how long it has become."""
    out = augment.inject_errors(_episodes(spark, sf_dir), seed=2, limit=2, ask_share=0.7)
    marked = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("i"), m.alias("m"))), lambda x: F.coalesce(x["m"]["context_only"], F.lit(False)))
    return out.select("episode_id", F.size("messages").alias("messages"), F.array_join(F.transform(marked, lambda x: x["i"].cast("string")), ",").alias("places"), F.array_join(F.transform(marked, lambda x: F.get(x["m"]["tool_calls"], 0)["arguments"]), "|").alias("arguments"))


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every episode after greeting, layout and results, each with a share of chances: its length, first words and number of results left in envelopes."""
    steps = {"greet": lambda e: augment.greet(e, 2), "layout": lambda e: augment.relayout(e, 2), "results": lambda e: augment.vary_results(e, 2)}
    out = augment.in_order(_episodes(spark, sf_dir), steps, {"greet": 0.3, "layout": 0.5, "results": 0.8}, seed=4)
    kept = F.filter("messages", lambda m: (m["role"] == "tool") & m["content"].startswith('{"ok"'))
    return out.select("episode_id", F.size("messages").alias("messages"), F.substring(F.get("messages", 0)["content"], 1, 8).alias("first"), F.size(kept).alias("envelopes"))


def _h(tag: str, key: str, seed: int = 2) -> str:
    return f"('0x' || substr(sha256('{seed}:{tag}:' || {key}), 1, 8))::BIGINT"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ORDERS = f"o AS (SELECT o_custkey AS e, o_orderkey AS k, o_orderstatus AS s, 'W' || o_orderkey AS v, {_list(TOOLS)}[o_orderkey % 3 + 1] AS tool, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS j FROM orders)"
RULE = "In each turn either send one message to the user or make tool calls."
STYLE = f"{_list(augment.STYLES)}[{_h('envelope', 'e')} % 4 + 1]"
LAYOUT = f"['markdown', 'policy_first', 'tags'][{_h('layout', 'e')} % 3 + 1]"
WORDS = [list(dict.fromkeys(t.split("_")))[0] for t in TOOLS] + ["order"]
OTHERS = "CASE w " + " ".join(f"WHEN '{w}' THEN {_list([o for o in next(g for g in augment.SYNONYMS if w in g) if o != w])}" for w in WORDS) + " END"

QUERIES = {
    "greeted": (
        greeted,
        f"""WITH e AS (SELECT DISTINCT o_custkey AS e FROM orders)
SELECT e AS episode_id, 'system,assistant,user' AS roles, CASE WHEN e % 4 = 0 THEN {_list(augment.GREETINGS["zh"])}[{_h("greet", "e")} % 2 + 1] ELSE {_list(augment.GREETINGS["en"])}[{_h("greet", "e")} % 3 + 1] END AS greeting FROM e""",
    ),
    "relaid": (
        relaid,
        f"""WITH e AS (SELECT DISTINCT o_custkey AS e FROM orders), n AS (SELECT e, {LAYOUT} AS l, chr(10) AS n, 'Be kind. Use get_order first.' AS i, 'No refunds.' AS p, chr(10) || chr(10) || 'Current time: 1' AS c FROM e)
SELECT e AS episode_id, CASE l WHEN 'tags' THEN '<instructions>' || n || i || n || '{RULE}' || n || '</instructions>' || n || '<policy>' || n || p || n || '</policy>' || c WHEN 'markdown' THEN '# Role' || n || i || n || n || '# Policy' || n || p || c ELSE 'Policy:' || n || p || n || n || i || c END AS system FROM n""",
    ),
    "varied_results": (
        varied_results,
        f"""WITH {ORDERS}, r AS (SELECT *, {STYLE} AS style FROM o)
SELECT e AS episode_id, string_agg(CASE WHEN style = 'envelope' THEN CASE WHEN k % 5 > 0 THEN '{{"ok": true, "result": "' || s || '"}}' ELSE '{{"ok": false, "error": "late"}}' END WHEN k % 5 > 0 THEN s WHEN style = 'raw' THEN 'Error: late' ELSE 'late' END, '|' ORDER BY k) AS results FROM r GROUP BY e""",
    ),
    "renamed_tools": (
        renamed_tools,
        f"""WITH {ORDERS}, t AS (SELECT DISTINCT e, tool FROM o), w AS (SELECT e, tool, i, string_split(tool, '_')[i + 1] AS w FROM t, range(2) r(i)),
d AS (SELECT *, {OTHERS} AS others, {_h("word", "e || ':' || tool || ':' || i")} AS h FROM w), n AS (SELECT e, tool, string_agg(CASE WHEN h % 5 < 4 THEN others[(h >> 8) % len(others) + 1] ELSE w END, '_' ORDER BY i) AS new FROM d GROUP BY 1, 2),
m AS (SELECT e, tool, CASE WHEN new = tool THEN {_list(augment.PREFIXES)}[{_h("prefix", "e || ':' || tool")} % 5 + 1] || '_' || tool ELSE new END AS new FROM n)
SELECT o.e AS episode_id, string_agg(m.new, ',' ORDER BY k) AS tools, 'Be kind. Use ' || coalesce(max(m.new) FILTER (WHERE o.tool = 'get_order'), 'get_order') || ' first.' AS prompt FROM o JOIN m ON m.e = o.e AND m.tool = o.tool GROUP BY 1""",
    ),
    "example_values": (
        example_values,
        f"""WITH {ORDERS}, g AS (SELECT e, string_agg(v, ' ') AS taken FROM o GROUP BY 1), f AS (SELECT e, tool, min_by(v, k) AS v FROM o WHERE length(v) >= 3 GROUP BY 1, 2),
c AS (SELECT f.*, taken, e || ':' || tool || ':order_id' AS key FROM f JOIN g USING (e)), x AS (SELECT *, list_concat(CASE WHEN {_h("zeros", "key")} / 4294967296.0::DOUBLE < 0.5 THEN [regexp_replace(v, '[0-9]', '0', 'g')] ELSE [] END,
list_transform(range(9), lambda i: translate(v, '0123456789', substr('01234567890123456789', 2 + (({_h("digits", "key")} + i) % 9)::INT, 10)))) AS options FROM c),
y AS (SELECT *, list_filter(options, lambda z: z <> v AND NOT contains(taken, z))[1] AS example FROM x) SELECT e AS episode_id, tool, 'order_id' AS parameter, example FROM y WHERE example IS NOT NULL""",
    ),
    "injected_errors": (
        injected_errors,
        f"""WITH {ORDERS}, g AS (SELECT e, count(*) AS n, list(v ORDER BY k) AS ids, coalesce(list(v) FILTER (WHERE k % 2 = 0), []) AS told FROM o GROUP BY 1),
c AS (SELECT o.*, n, ids, 2 + 2 * j AS pos, len(list_filter(told, lambda x: contains(x, v))) > 0 AS said, len(list_filter(ids[1:j], lambda x: contains(x, v))) > 0 AS met FROM o JOIN g USING (e) WHERE k % 3 < 2 AND length(v) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY {_h("inject", "e || ':' || pos")}, pos) AS r FROM c WHERE said OR met),
p AS (SELECT *, (2 + {_h("place", "e || ':' || pos")} % (length(v) - 1))::INT AS p FROM r WHERE r <= 2),
w AS (SELECT *, substr(v, 1, p - 1) || (substr(v, p, 1)::INT + 1 + {_h("digit", "e || ':' || pos")} % 9) % 10 || substr(v, p + 1) AS wrong FROM p),
k AS (SELECT *, CASE WHEN said AND {_h("asks", "e || ':' || pos")} / 4294967296.0::DOUBLE < 0.7::DOUBLE THEN 4 ELSE 2 END AS size FROM w WHERE len(list_filter(ids, lambda x: contains(x, wrong))) = 0),
i AS (SELECT *, pos + coalesce(sum(size) OVER (PARTITION BY e ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM k)
SELECT g.e AS episode_id, (3 + 2 * any_value(g.n) + coalesce(sum(size), 0))::INT AS messages, coalesce(string_agg(place::VARCHAR, ',' ORDER BY pos), '') AS places, coalesce(string_agg('{{"order_id": "' || wrong || '"}}', '|' ORDER BY pos), '') AS arguments FROM g LEFT JOIN i USING (e) GROUP BY 1""",
    ),
    "augmented": (
        augmented,
        f"""WITH {ORDERS}, e AS (SELECT e, count(*) AS n, {LAYOUT} AS l, {STYLE} AS style FROM o GROUP BY 1), u AS (SELECT *, {_h("greet", "e", 4)} / 4294967296.0::DOUBLE < 0.3::DOUBLE AS g, {_h("layout", "e", 4)} / 4294967296.0::DOUBLE < 0.5::DOUBLE AS x, {_h("results", "e", 4)} / 4294967296.0::DOUBLE < 0.8::DOUBLE AS y FROM e)
SELECT e AS episode_id, (2 * n + 3 + g::INT)::INT AS messages, CASE WHEN NOT x THEN 'Be kind.' WHEN l = 'tags' THEN '<instruc' WHEN l = 'markdown' THEN '# Role' || chr(10) || 'B' ELSE 'Policy:' || chr(10) END AS first, CASE WHEN y AND style <> 'envelope' THEN 0 ELSE n END::INT AS envelopes FROM u""",
    ),
}
