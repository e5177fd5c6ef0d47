"""The registered queries of the training-data operators, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, cws, decontam, licenses, mixing, quality, runs, secrets_scan, sharding, simhash, token_counts, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by the factorisation machine."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix of sources takes of each document."""
    return mixing.mix_documents(table(spark, sf_dir, "documents")).drop("h")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, read back from the formatted output, of all conversations and conversation -7."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    out = chat.format_conversations(rows.unionByName(extra))
    turns, loss = chat.read_back(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by documents."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that all documents hold."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts."""
    out = cws.fingerprints(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("signature"), F.col("edited_signature"), F.col("next_signature")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        cws.hexadecimal(own).alias("fingerprint"),
        cws.hexadecimal(edited).alias("edited_fingerprint"),
        cws.likeness(own, edited).alias("near_edited"),
        cws.likeness(own, following).alias("near_next"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    out = secrets_scan.scan(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in (*secrets_scan.KINDS, *[f"like_{k}" for k in secrets_scan.KINDS])])
    n = len(secrets_scan.KINDS)
    name = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secrets_scan.KINDS.index(k))).cast("long").alias(f"n_{k}")
    later = F.transform("added", lambda s: F.struct((s["kind"] + n).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    order = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return out.select(
        "doc_id",
        *[count(k) for k in secrets_scan.KINDS],
        F.sha2(F.array_join(F.transform(order(F.col("base")), name), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(order(F.concat(F.col("base"), later)), name), ",").alias("spans"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures; the table has no time, so the page's number gives one within 2024."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525_600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + minute * 60).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list for the pages: two fixed domains, and by the MD5 of its name every fourth host, added, removed and added again."""
    day = lambda d: F.timestamp_seconds(F.lit(1_704_067_200) + d * 86_400)
    hosts = pages.select(url_filter.host(F.col("url")).alias("pattern")).where("pattern <> ''").distinct()
    code = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 7), 16, 10).cast("long")
    chosen = hosts.withColumn("code", code).where("code % 4 = 0")
    first = F.col("code") % 200
    stages = F.array(
        F.struct(day(first).alias("at"), F.lit(True).alias("listed")),
        F.struct(day(first + 60).alias("at"), F.lit(False).alias("listed")),
        F.struct(day(first + 60 + F.col("code") % 90).alias("at"), F.lit(True).alias("listed")),
    )
    fixed = pages.sparkSession.sql(
        "SELECT * FROM VALUES ('example.org', timestamp_seconds(1714521600), true), ('example.org', timestamp_seconds(1717200000), false),"
        " ('example.net/de', timestamp_seconds(1709251200), true) AS t(pattern, at, listed)"
    )
    return chosen.select("pattern", F.inline(stages)).unionByName(fixed)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, evaluated against the list entries active when they were fetched."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.evaluate(captures(pages), dated_list(pages)).select("page_id", "fetched", "blocked", "pattern", "since")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the byte-level vocabulary and the sentencepiece one, aligned."""
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = alignment.align(table(spark, sf_dir, "documents"), lambda: alignment.byte_level(a), lambda: alignment.sentence_pieces(b))
    return out.withColumnRenamed("groups", "groups_sha256")


def repeated_tails(documents: DataFrame) -> DataFrame:
    """doc_id and words of all documents; of every tenth by the CRC-32 of its id, the words from a place on repeat with a period, both by rule."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = documents.select("doc_id", h.alias("h"), runs.words_of(runs.text_of(documents)).alias("words")).withColumn("n", F.size("words"))
    g = F.floor(F.col("h") / 10)
    out = out.withColumn("a", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), g % F.col("n")).cast("int"))
    out = out.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    words, a, p = F.col("words"), F.col("a"), F.col("p")
    tail = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))
    return out.select("doc_id", F.when(a.isNull(), words).otherwise(tail).alias("words"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of all documents, tails repeated as the contract says."""
    docs = repeated_tails(table(spark, sf_dir, "documents"))
    out = runs.collapse(docs, words=F.col("words"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = out.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, by the sentencepiece vocabulary."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_licenses,
        op2_simhash,
        op3_fingerprints,
        op4_quality,
        op5_mixing,
        op6_secrets,
        op7_chat,
        op8_url_filter,
        op9_sharding,
        op10_decontamination,
        op11_alignment,
        op12_runs,
        op13_token_counts,
        pipeline,
    )
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)
