"""Mixing sources to target weights along a low-discrepancy schedule of equal-token blocks.

The words of each source, its documents in a shuffled order and repeated for up to ``epochs`` rounds, are cut into blocks
of equally many words. Slot i of the schedule takes the golden-ratio point of i, finds the source whose piece of the
cumulative target weights holds the point, and the source's r-th slot gets the source's r-th block. So every stretch of
the schedule is near the target weights. A source's last block ends at its target; the few blocks that a source still
lacks after the last point, as points are spread evenly but for a logarithm, close the schedule. So each source's words
are its target, rounded. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import offsets_before, text_of, word_count, written

GOLDEN = (math.sqrt(5) - 1) / 2
_STEP = 1 << 20


def golden_point(i: Column) -> Column:
    """frac(i * golden ratio) of a non-negative long, precise to about 1e-10 up to 2**40."""
    high = (F.lit(_STEP) * F.lit(GOLDEN)) % 1
    return (F.shiftright(i, 20) * high + i.bitwiseAND(F.lit(_STEP - 1)) * F.lit(GOLDEN)) % 1


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): adds number, weight and target.

    Sources by code point, null last, get the repeating weights and share the total size by weight. A target stops at
    ``epochs`` times its source's size; the excess goes to the others by weight until none is above. That fixed point is
    found in one pass: by rising ratio of stop to weight, a source stops if its stop is within its share of what the
    sources before it have left. One row per source goes through a single window.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("number", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("number", F.lit(len(weights))) + 1)
    )
    rows = rows.withColumn("stop", F.col("source_size") * F.lit(float(epochs)))
    rising = Window.orderBy(F.col("stop") / F.col("weight"), "number")
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    share = (F.sum("source_size").over(whole) - F.coalesce(F.sum("stop").over(before), zero)) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)
    )
    rows = rows.withColumn("share", share)
    level = F.first(F.when(F.col("stop") > F.col("share") * F.col("weight"), F.col("share")), ignorenulls=True)
    rows = rows.withColumn("level", level.over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least("stop", F.col("level") * F.col("weight")), F.col("stop"))
    return rows.select("source", "source_size", "number", "weight", target.alias("target"))


def schedule(spark: SparkSession, sources: DataFrame, slots: int, cells: int = 1024) -> DataFrame:
    """slot, number and rank: slot i belongs to the source whose piece of the cumulative targets holds i's golden point.

    ``sources`` has number and target. The points are matched to pieces inside ``cells`` equal cells of [0, 1); ranks are
    counted per run of about sqrt(slots) slots first, so no source's slots meet in one task.
    """
    whole, up_to = Window.partitionBy(), Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    pieces = sources.where("target > 0").select(
        "number", (F.sum("target").over(up_to) / F.sum("target").over(whole)).alias("to"), F.count("*").over(whole).alias("n"), F.row_number().over(Window.orderBy("number")).alias("k")
    )
    pieces = pieces.withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("number")), F.lit(0.0)))
    pieces = pieces.withColumn("to", F.when(F.col("k") == F.col("n"), 2.0).otherwise(F.col("to")))
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1)).cast("int")
    pieces = pieces.select("number", "from", "to", F.explode(F.sequence(cell(F.col("from")), cell(F.col("to")))).alias("cell"))
    run = max(4096, math.isqrt(slots))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("x"))
    points = points.withColumn("cell", cell(F.col("x")))
    owned = points.join(pieces, "cell").where("x >= from and x < to").select("slot", "number", F.floor(F.col("slot") / run).alias("run"))
    owned = written(owned)
    offsets = offsets_before(owned.groupBy("number", "run").count(), ["number"], "run", "count")
    within = Window.partitionBy("number", "run").orderBy("slot")
    return owned.join(offsets, ["number", "run"]).select("slot", "number", (F.col("offset") + F.row_number().over(within) - 1).alias("rank"))


def closed(slots: DataFrame, sources: DataFrame, first: int, block: int) -> DataFrame:
    """slots with those of the blocks that sources lack up to their targets, from slot number ``first`` on."""
    held = slots.groupBy("number").agg((F.max("rank") + 1).alias("blocks"))
    facts = sources.join(held, "number", "left").select("number", F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"), F.ceil(F.round("target") / block).cast("long").alias("wanted"))
    more = facts.where("wanted > blocks").select("number", F.explode(F.sequence("blocks", F.col("wanted") - 1)).alias("rank"))
    slot = F.lit(first).cast("long") + F.row_number().over(Window.orderBy("rank", "number")) - 1
    return slots.unionByName(more.select(slot.alias("slot"), "number", "rank"))


def mix_documents(
    documents: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    epochs: int = 3,
    block_words: int = 256,
    cells: int = 1 << 14,
    text: str = "text",
    id: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """id, h (XXH64 of id and text), size, source_size, target and taken (words the mix takes) of every row.

    Null texts have size 0; documents without words are kept with taken 0; null sources are a source of their own, null
    ids an id; repeated rows are rows of their own, laid one after another; an empty table gives an empty result; other
    columns are left out. The shuffle is by hash, so reruns agree. Positions inside a source are counted over ``cells`` hash
    cells first.
    """
    body = text_of(documents, text)
    base = written(
        documents.select(documents[id].alias("id"), documents[source].cast("string").alias("source"), word_count(body).alias("size"), F.xxhash64(documents[id], body).alias("h"))
    )
    spark = documents.sparkSession
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(source_targets(sizes, weights, epochs))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block, points = block_words, -(-total // block_words)
    slots = written(schedule(spark, sources, points))
    slots = closed(slots, sources, points, block)

    facts = sources.select("source", "number", "source_size", "target", F.round("target").cast("long").alias("reach"))
    same = base.groupBy("id", "source", "size", "h").agg(F.count("*").alias("copies"))
    rows = same.join(facts, same["source"].eqNullSafe(facts["source"])).drop("source")
    rows = rows.withColumn("cell", F.expr(f"shiftrightunsigned(h, {64 - (cells - 1).bit_length()})").cast("int"))
    per_cell = offsets_before(rows.groupBy("number", "cell").agg(F.sum(F.col("size") * F.col("copies")).alias("words")), ["number"], "cell", "words")
    in_order = Window.partitionBy("number", "cell").orderBy("h", "id", "size")
    so_far = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = rows.join(per_cell, ["number", "cell"]).withColumn("first", F.col("offset") + so_far)
    laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumn("start", F.col("first") + (F.col("copy") - 1) * F.col("size"))

    def parts(epoch: int) -> Column:
        """The blocks that a document reaches into in one round, with its words in each."""
        at = F.col("start") + F.col("source_size") * epoch
        end = F.least(at + F.col("size"), F.col("reach"))
        first, last = F.floor(at / block), F.floor((end - 1) / block)
        piece = lambda k: F.struct(k.alias("rank"), (F.least(end, (k + 1) * block) - F.greatest(at, k * block)).alias("words"))
        none = F.expr("cast(array() as array<struct<rank:bigint,words:bigint>>)")
        return F.when(end > at, F.transform(F.sequence(first, last), piece)).otherwise(none)

    key = ["number", "copy", "id", "h", "size", "source_size", "target"]
    spread = laid.select(*key, F.explode_outer(F.flatten(F.array(*[parts(e) for e in range(epochs)]))).alias("part"))
    spread = spread.select(*key, F.col("part.rank").alias("rank"), F.col("part.words").alias("words"))
    joined = spread.join(slots.select("number", "rank", F.lit(True).alias("held")), ["number", "rank"], "left")
    taken = joined.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("held"), F.col("words"))), F.lit(0)).alias("taken"))
    return taken.select(F.col("id").alias(id), "h", "size", "source_size", "target", "taken")


def mixed_copies(documents: DataFrame, text: str = "text", id: str = "doc_id", **parameters) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it: taken over size, rounded half up (once cut in a block).

    Null texts, empty texts and texts without words take no words and are in no mix; null ids and sources are values like
    others; of repeated rows one is read and taken as often as all of them; an empty table gives an empty result; all columns
    are kept, whatever their names.
    """
    counts = mix_documents(documents, text=text, id=id, **parameters).select(F.col(id).alias("of"), "h", "size", "taken").where("taken > 0")
    counts = counts.groupBy("of", "h").agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("times"))
    keyed = documents.select(documents[id].alias("id"), F.xxhash64(documents[id], text_of(documents, text)).alias("k"), F.struct("*").alias("document"))
    out = keyed.dropDuplicates(["id", "k"]).join(counts, F.col("id").eqNullSafe(F.col("of")) & (F.col("k") == F.col("h")))
    return out.where("times > 0").select("document", F.explode(F.sequence(F.lit(1), "times"))).select("document.*")
