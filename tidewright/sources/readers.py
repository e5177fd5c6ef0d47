"""Readers and sinks: teacher rows, metric journals, task manifests, bundles, replay groups, public chat data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALL = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])
MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tool_calls", T.ArrayType(CALL)),
        T.StructField("tool_call_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("context_only", T.BooleanType()),
    ]
)
TEACHER = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("world", T.StringType()),
        T.StructField("reward", T.DoubleType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("terminated", T.BooleanType()),
        T.StructField("consent", T.StringType()),
        T.StructField("state_ok", T.BooleanType()),
        T.StructField("safety", T.BooleanType()),
        T.StructField("field_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("naming", T.MapType(T.StringType(), T.StringType())),
        T.StructField("language", T.StringType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("speech_leaks", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)
TASKS = T.StructType([T.StructField("id", T.StringType()), T.StructField("sandbox", T.StringType()), T.StructField("split", T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField("identity", T.StringType())])


def teacher_rows(spark: SparkSession, paths: list[str], tasks: DataFrame | None = None, max_failed: int = 3) -> DataFrame:
    """Usable episodes of JSONL files: successful, with messages, known tasks, no leaks, few failed results."""
    from tidewright.functions.scalars import is_failure

    rows = spark.read.schema(TEACHER).json(paths)
    failed = F.size(F.filter("messages", lambda m: (m["role"] == "tool") & is_failure(m["content"])))
    kept = rows.where(F.coalesce("success", F.lit(False)) & (F.coalesce(F.size("messages"), F.lit(0)) > 0) & (F.coalesce("speech_leaks", F.lit(0)) == 0) & (failed <= max_failed))
    return kept if tasks is None else kept.join(tasks.select("id"), "id", "left_semi")


def near_misses(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Failed episodes that were safe, left the right state, earned 0.85 or more, and have at most one field wrong."""
    rows = spark.read.schema(TEACHER).json(paths)
    wrong = F.size(F.filter(F.map_values("field_scores"), lambda s: s < 1))
    return rows.where(
        ~F.coalesce("success", F.lit(False)) & F.coalesce("state_ok", F.lit(False)) & F.coalesce("safety", F.lit(True)) & (F.coalesce("reward", F.lit(0.0)) >= 0.85) & (F.coalesce(wrong, F.lit(0)) <= 1) & (F.coalesce("speech_leaks", F.lit(0)) == 0)
    )


def metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """number and record (VARIANT) of a journal of JSON lines; lines that do not parse, such as a cut last one, are left out.

    Lines are numbered from 0 by file and place in it, whatever pieces the files are read in: lines are counted by piece.
    """
    return numbered_lines(spark, path).select("number", F.try_parse_json("value").alias("record")).where("record is not null")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """number and value of the lines of text files, by file and place."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    pieces = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(pieces.select("f", "b", "first", before.alias("before")), ["f", "b"]).select((F.col("before") + F.col("i") - F.col("first")).alias("number"), "value")


def append_journal(records: DataFrame, path: str) -> None:
    """Appends records as JSON lines under Spark's commit protocol; a double that is not finite becomes null."""
    clean = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, t in records.dtypes if t in ("double", "float")}
    records.withColumns(clean).write.mode("append").json(path)


def journal_digest(lines: DataFrame) -> DataFrame:
    """For each run of 65536 lines (number, value) its count, bytes and the SHA-256 of its lines' SHA-256, to compare a committed prefix.

    Lines are hashed where they are, so what meets in a run is a digest a line.
    """
    line = F.concat(F.col("value"), F.lit("\n"))
    hashed = lines.select(F.floor(F.col("number") / 65536).alias("run"), "number", F.octet_length(line).alias("b"), F.sha2(line.cast("binary"), 256).alias("h"))
    whole = F.array_join(F.array_sort(F.collect_list(F.struct("number", "h")))["h"], "")
    return hashed.groupBy("run").agg(F.count("*").alias("lines"), F.sum("b").alias("bytes"), F.sha2(whole.cast("binary"), 256).alias("sha256"))


def finite_metrics(events: DataFrame) -> DataFrame:
    """Events with only the finite values of their map ``metrics``."""
    return events.withColumn("metrics", F.map_filter("metrics", lambda k, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def task_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a JSON manifest with their problems: repeated ids or identities, weights that are not finite and positive."""
    rows = spark.read.schema(T.StructType([T.StructField("tasks", T.ArrayType(TASKS))])).json(path, multiLine=True).select(F.inline("tasks"))
    per = lambda c: F.count("*").over(Window.partitionBy(c))
    bad = {"repeated id": per("id") > 1, "repeated identity": F.col("identity").isNotNull() & (per("identity") > 1), "bad weight": ~((F.col("weight") > 0) & (F.col("weight") < float("inf"))), "unknown split": ~F.col("split").isin("train", "eval")}
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(t)) for t, c in bad.items()])))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Files of a manifest (name, sha256) that are missing or differ, with both hashes; empty for a sound bundle."""
    actual = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("actual"))
    return manifest.join(actual, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("actual")))


def policy_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One policy report per bundle below a folder, the natural one before others."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "policy*.json").json(path, multiLine=True).withColumn("__p", F.input_file_name())
    bundle, name = F.regexp_extract("__p", "(.*)/[^/]*$", 1), F.element_at(F.split("__p", "/"), -1)
    place = F.row_number().over(Window.partitionBy("bundle").orderBy(~F.contains("name", F.lit("natural")), "name"))
    return rows.withColumn("bundle", bundle).withColumn("name", name).withColumn("__k", place).where("__k = 1").drop("__k", "__p", "name")


def replay_groups(spark: SparkSession, path: str, schema: str, policy: str) -> DataFrame:
    """Groups of ``group-*.json`` with their file's name and hash, of one policy; a hash counts once, by name."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "group-*.json").json(path, multiLine=True).withColumn("path", F.input_file_name())
    hashes = file_hashes(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    named = rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(hashes, "name").where(F.col("policy_identity") == policy)
    place = F.row_number().over(Window.partitionBy("sha256").orderBy("name"))
    return named.withColumn("__k", place).where("__k = 1").drop("__k")


def replay_buffer(entries: DataFrame, capacity: int) -> DataFrame:
    """The newest ``capacity`` entries (arrival, sha256), each hash once, at its first arrival."""
    first = entries.withColumn("__k", F.row_number().over(Window.partitionBy("sha256").orderBy("arrival"))).where("__k = 1").drop("__k")
    return first.orderBy(F.desc("arrival")).limit(capacity)


def chat_turns(rows: DataFrame, text: str, markers: tuple[str, ...] = ("USER:", "ASSISTANT:", "FUNCTION RESPONSE:")) -> DataFrame:
    """Adds turns (role, content) of a chat kept in one text, split at role markers."""
    pattern = "(?=" + "|".join(markers) + ")"
    parts = F.filter(F.split(F.trim(text), pattern), lambda p: F.trim(p) != "")
    body = "|".join(markers)
    turn = lambda p: F.struct(
        F.rtrim(F.lower(F.regexp_extract(p, f"^({body})", 1)), F.lit(":")).alias("role"), F.regexp_replace(p, rf"^({body})\s*|\s+$", "").alias("content")
    )
    return rows.withColumn("turns", F.transform(parts, turn))


def pythonic_calls(text):
    """Calls (name, arguments as JSON) of a text like ``[f(a=1), g()]``; null where it is none, or where values are not literals."""

    @F.arrow_udf("array<struct<name:string,arguments:string>>")
    def of(values):
        import ast
        import json

        import pyarrow as pa

        def read(v: str | None):
            try:
                tree = ast.parse(v.strip(), mode="eval").body
                calls = tree.elts if isinstance(tree, ast.List) else [tree]
                return [{"name": ast.unparse(c.func), "arguments": json.dumps({k.arg: ast.literal_eval(k.value) for k in c.keywords}, ensure_ascii=False)} for c in calls]
            except (SyntaxError, ValueError, AttributeError, TypeError):
                return None

        return pa.array([read(v) for v in values.to_pylist()], pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())])))

    return of(text)


def asking_and_declining(rows: DataFrame, content: str, count: int, id: str, share: float = 0.75, seed: int = 0) -> DataFrame:
    """Of rows whose last message (``content``) asks back floor(count * share), of those whose does not the rest of ``count``, by hash order: a sampling operator."""
    from tidewright.functions.ordering import hash_order
    from tidewright.operators.selection import numbered

    asks = F.coalesce(F.contains(F.col(content), F.lit("?")), F.lit(False))
    first = lambda part, n, tag: numbered(part, hash_order(seed, tag, id), [id], "__p").where(F.col("__p") < n).drop("__p")
    many = int(count * share)
    return first(rows.where(asks), many, "asking").unionByName(first(rows.where(~asks), count - many, "declining"))


def sample_shares(rows: DataFrame, kind: str, shares: dict[str, float], count: int, id: str, seed: int = 0) -> DataFrame:
    """``count`` rows, each kind with its share, by hash order: a sampling operator."""
    from tidewright.functions.ordering import hash_order

    parts = [rows.where(F.col(kind) == k).orderBy(hash_order(seed, k, id), id).limit(round(count * s)) for k, s in shares.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_examples(examples: DataFrame, episode: str, valid_share: float, path: str, seed: int = 0) -> None:
    """Writes train and valid JSON lines, whole episodes on one side."""
    from tidewright.functions.ordering import hash_uniform

    tagged = examples.withColumn("part", F.when(hash_uniform(seed, "valid", episode) < valid_share, "valid").otherwise("train"))
    tagged.write.mode("overwrite").partitionBy("part").json(path)


def scene_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and undirected edges (a, b) kept as Parquet."""
    pairs = spark.read.parquet(edges).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return spark.read.parquet(nodes).select("id", "name"), pairs
