"""Queries on what readers and adapters make of files and texts that are written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.functions import speech
from tidewright.operators import graph
from tidewright.operators import text as X
from tidewright.plans.grading import _graph
from tidewright.sources import readers
from tidewright.sources import tables as T
from tidewright.sources.shared import shared_folder


def _teacher_file(spark: SparkSession, sf_dir: str) -> str:
    """Orders as a teacher's JSON lines, in the shared folder: their messages, results and scores by rules of their numbers."""
    k = F.col("o_orderkey")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    results = F.transform(F.sequence(F.lit(0), (k % 6).cast("int")), lambda i: message("tool", F.when(i < k % 5, "Error: no").otherwise("fine")))
    messages = F.when(k % 8 == 0, F.slice(results, 1, 0)).otherwise(F.concat(F.array(message("user", k.cast("string"))), results))
    rows = T.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), (k % 3 > 0).alias("success"), messages.alias("messages"), F.when(k % 7 == 0, 1).alias("speech_leaks"), (k % 2 == 0).alias("state_ok"), F.when(k % 11 == 0, False).alias("safety"),
        ((k % 20) / 20 + 0.05).alias("reward"), F.create_map(F.lit("a"), F.when(k % 4 == 0, 0.5).otherwise(1.0), F.lit("b"), F.when(k % 12 == 0, 0.5).otherwise(1.0)).alias("field_scores"),
    )
    path = f"{shared_folder(spark)}/fixtures/{uuid.uuid4().hex}"
    rows.write.json(path)
    return path


def teacher_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable episodes of a teacher's file, of tasks with even numbers."""
    tasks = T.table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("id"))
    return readers.teacher_rows(spark, [_teacher_file(spark, sf_dir)], tasks).select("id", F.size("messages").alias("messages"))


def near_miss_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed episodes of a teacher's file that came near."""
    return readers.near_misses(spark, [_teacher_file(spark, sf_dir)]).select("id", F.round("reward", 6).alias("reward"))


def chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations told in one text with role markers, read back into turns."""
    said = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " ")
    line = F.concat(F.when(F.col("role") == "assistant", "ASSISTANT: ").otherwise("USER: "), said)
    whole = T.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))["l"], "\n\n").alias("t"))
    turns = readers.chat_turns(whole, F.col("t"))
    return turns.select("conv_id", F.size("turns").alias("turns"), F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("|"), x["content"])), "\n").cast("binary"), 256).alias("digest"))


def called_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls written as code, read back as names and JSON arguments; some are no calls."""
    k = F.col("o_orderkey")
    call = F.concat(F.lit("get_order(id="), k, F.lit(", name='"), "o_orderpriority", F.lit("', deep=["), k % 3, F.lit(", None, True])"))
    text = F.when(k % 5 == 0, F.concat(F.lit("get_order(id="), k)).when(k % 5 == 1, call).when(k % 5 == 2, F.concat(F.lit("["), call, F.lit(", mail.send()]"))).when(k % 5 == 3, F.concat(F.lit("f(x="), k, F.lit(" + y)"))).otherwise("[]")
    calls = readers.pythonic_calls(text)
    rows = T.table(spark, sf_dir, "orders").select(k, calls.alias("c"))
    return rows.select("o_orderkey", F.coalesce(F.array_join(F.transform("c", lambda x: F.concat(x["name"], x["arguments"])), "|"), F.lit("none")).alias("calls"))


def public_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources made of conversations: those that ask back and those that do not, told chats, and the rest by a share; without those that share an 8-gram with the benchmark, by source."""
    m = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    c = m.groupBy("conv_id").agg(F.max_by("text", "turn").alias("last"), F.array_join(F.array_sort(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("whole"))
    asking = readers.asking_and_declining(c.where("conv_id % 3 = 0"), "last", 60, "conv_id").withColumn("source", F.lit("asking"))
    shares = readers.sample_shares(c.where("conv_id % 3 = 1").withColumn("kind", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")), "kind", {"even": 0.4, "odd": 0.6}, 50, "conv_id").drop("kind").withColumn("source", F.lit("shares"))
    told = c.where("conv_id % 3 = 2").withColumn("source", F.lit("told"))
    rows = asking.unionByName(shares).unionByName(told)
    kept = X.decontaminated(rows, "conv_id", "whole", T.table(spark, sf_dir, "benchmark"), "text")
    return rows.groupBy("source").agg(F.count("*").alias("read")).join(kept.groupBy("source").agg(F.count("*").alias("kept")), "source")


def scene_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every customer three steps over the orders next to each other."""
    _, edges = _graph(spark, sf_dir)
    starts = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("walk"), F.concat(F.lit("c"), "c_custkey").alias("id"))
    return graph.walks(edges, starts, 3, seed=5).select("walk", F.array_join("path", ">").alias("path"))


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of objects written in another order, and the keys of texts in full width and with spaces."""
    k = F.col("p_partkey")
    json = F.concat(F.lit('{"size" : '), "p_size", F.lit(', "a": {"z": [1, {"y": null,  "x": true}], "name": "'), "p_name", F.lit('"}}'))
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    return T.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(S.canonical_json(F.when(k % 9 == 0, "{").otherwise(json)), F.lit("none")).alias("canonical"), S.text_key(F.concat(F.lit(" ﬁ　"), wide, F.lit("\tＸ"))).alias("key"))


def spoken_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sentences say the day and the hour of orders, and what of their values they bear out."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    said_day = F.when(k % 4 == 0, F.date_format(day, "MMMM d, yyyy")).when(k % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(k % 4 == 2, F.date_format(F.date_add(day, 1), "MMMM d")).otherwise("some day")
    hour = (k % 24).cast("int")
    said_hour = F.when(k % 3 == 0, F.format_string("%d:15 %s", F.when(hour % 12 == 0, 12).otherwise(hour % 12), F.when(hour >= 12, "pm").otherwise("am"))).when(k % 3 == 1, F.format_string("%02d:15", hour)).otherwise("then")
    line = F.concat(F.lit("It comes on "), said_day, F.lit(" at "), said_hour, F.lit("."))
    value, clock = F.date_format(day, "yyyy-MM-dd"), F.format_string("%02d:15", hour)
    rows = T.table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"), value.alias("value"), clock.alias("clock")).withColumn("said", speech.stated(F.col("line")))
    heard = lambda kind, v: F.coalesce(speech.verified(F.col("line"), F.col("said"), F.lit(kind), F.col(v)), F.lit("none"))
    return rows.select("o_orderkey", speech.says_date(F.col("said"), F.col("value")).alias("day"), speech.says_time(F.col("said"), F.col("clock")).alias("hour"), heard("string", "value").alias("kept_day"), heard("string", "clock").alias("kept_hour"), heard("enum", "value").alias("kept_enum"))


FAILED = "CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE least(o_orderkey % 6 + 1, o_orderkey % 5) END"
HASH = "sha256('0:{}:' || conv_id)"

QUERIES = {
    "teacher_episodes": (
        teacher_episodes,
        f"SELECT o_orderkey::VARCHAR AS id, (o_orderkey % 6 + 2)::INT AS messages FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 8 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 2 = 0 AND {FAILED} <= 3",
    ),
    "near_miss_episodes": (
        near_miss_episodes,
        "SELECT o_orderkey::VARCHAR AS id, round(o_orderkey % 20 / 20.0::DOUBLE + 0.05::DOUBLE, 6) AS reward FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 11 > 0 AND o_orderkey % 20 / 20.0::DOUBLE + 0.05::DOUBLE >= 0.85::DOUBLE AND o_orderkey % 12 > 0 AND o_orderkey % 7 > 0",
    ),
    "chat_round_trip": (
        chat_round_trip,
        r"""WITH l AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'assistant|' ELSE 'user|' END || trim(regexp_replace(trim(coalesce(text, '')), '\s+', ' ', 'g')) AS l FROM conversations)
SELECT conv_id, count(*)::INT AS turns, sha256(string_agg(l, chr(10) ORDER BY turn)) AS digest FROM l GROUP BY 1""",
    ),
    "called_functions": (
        called_functions,
        """WITH c AS (SELECT o_orderkey AS k, 'get_order{"id": ' || o_orderkey || ', "name": "' || o_orderpriority || '", "deep": [' || o_orderkey % 3 || ', null, true]}' AS c FROM orders)
SELECT k AS o_orderkey, CASE k % 5 WHEN 1 THEN c WHEN 2 THEN c || '|mail.send{}' WHEN 4 THEN '' ELSE 'none' END AS calls FROM c""",
    ),
    "public_mix": (
        public_mix,
        rf"""WITH c AS (SELECT conv_id, max_by(coalesce(text, ''), turn) AS last, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY 1),
a AS (SELECT *, contains(last, '?') AS asks FROM c WHERE conv_id % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY asks ORDER BY CASE WHEN asks THEN {HASH.format("asking")} ELSE {HASH.format("declining")} END, conv_id) AS p FROM a),
s AS (SELECT *, conv_id % 2 = 0 AS even, row_number() OVER (PARTITION BY conv_id % 2 ORDER BY CASE WHEN conv_id % 2 = 0 THEN {HASH.format("even")} ELSE {HASH.format("odd")} END, conv_id) AS p FROM c WHERE conv_id % 3 = 1),
rows AS (SELECT conv_id, whole, 'asking' AS source FROM r WHERE p <= CASE WHEN asks THEN 45 ELSE 15 END UNION ALL SELECT conv_id, whole, 'shares' FROM s WHERE p <= CASE WHEN even THEN 20 ELSE 30 END UNION ALL SELECT conv_id, whole, 'told' FROM c WHERE conv_id % 3 = 2),
b AS (SELECT regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}\p{{M}}_]+') AS w FROM benchmark), d AS (SELECT conv_id, regexp_extract_all(lower(whole), '[\p{{L}}\p{{N}}\p{{M}}_]+') AS w FROM rows),
banned AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM b WHERE len(w) >= 8),
hit AS (SELECT DISTINCT conv_id FROM (SELECT conv_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM d WHERE len(w) >= 8) SEMI JOIN banned USING (gram))
SELECT source, count(*) AS read, count(*) FILTER (WHERE conv_id NOT IN (SELECT conv_id FROM hit)) AS kept FROM rows GROUP BY 1""",
    ),
    "scene_walks": (
        scene_walks,
        """WITH e AS (SELECT 'o' || o_orderkey AS a, coalesce('o' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 'c' || o_custkey) AS b FROM orders), n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
s0 AS (SELECT c_custkey AS w, ['c' || c_custkey] AS p FROM customer),
x1 AS (SELECT w, min_by(b, sha256('5:walk0:' || w || ':' || b) || b) AS b FROM s0 JOIN n ON a = p[-1] WHERE NOT list_contains(p, b) GROUP BY 1), s1 AS (SELECT w, CASE WHEN b IS NULL THEN p ELSE list_append(p, b) END AS p FROM s0 LEFT JOIN x1 USING (w)),
x2 AS (SELECT w, min_by(b, sha256('5:walk1:' || w || ':' || b) || b) AS b FROM s1 JOIN n ON a = p[-1] WHERE NOT list_contains(p, b) GROUP BY 1), s2 AS (SELECT w, CASE WHEN b IS NULL THEN p ELSE list_append(p, b) END AS p FROM s1 LEFT JOIN x2 USING (w)),
x3 AS (SELECT w, min_by(b, sha256('5:walk2:' || w || ':' || b) || b) AS b FROM s2 JOIN n ON a = p[-1] WHERE NOT list_contains(p, b) GROUP BY 1), s3 AS (SELECT w, CASE WHEN b IS NULL THEN p ELSE list_append(p, b) END AS p FROM s2 LEFT JOIN x3 USING (w))
SELECT w AS walk, array_to_string(p, '>') AS path FROM s3""",
    ),
    "text_keys": (
        text_keys,
        r"""SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'none' ELSE '{"a":{"name":"' || p_name || '","z":[1,{"x":true,"y":null}]},"size":' || p_size || '}' END AS canonical, 'fi' || regexp_replace(lower(p_name), '\s+', '', 'g') || 'x' AS key FROM part""",
    ),
    "spoken_moments": (
        spoken_moments,
        """WITH o AS (SELECT o_orderkey, o_orderkey % 4 < 2 AS day, o_orderkey % 3 < 2 AS hour, strftime(o_orderdate, '%Y-%m-%d') AS d, lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':15' AS h FROM orders)
SELECT o_orderkey, day, hour, CASE WHEN day THEN d ELSE 'none' END AS kept_day, CASE WHEN hour THEN h ELSE 'none' END AS kept_hour, d AS kept_enum FROM o""",
    ),
}
