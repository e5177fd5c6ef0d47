"""Sharding into contiguous runs of atomic groups under the smallest feasible capacity.

Documents with equal texts form a group that no cut may split; groups are ordered by the XXH64 of the text. A binary
search finds the smallest capacity under which a greedy walk over the ordered sizes needs no more than the wanted shards.
So that the walk never needs all groups, it starts from a list of sums over the leading bits of the hash. Taken as atomic
these sums give a capacity that is surely enough, taken as divisible one that is surely needed. While the two differ, the
sums that a cut may fall into are split by further bits, at most ``REFINED`` of them at a time, down to single groups if
need be. When the two agree the capacity is that of the groups, and the cuts are placed under it, each shard aiming at an
even share of what is left. Everything is a DataFrame or SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import offsets_before, text_of, written


#: Leading bits of the hash of the first sums, the bits by which a sum is split further, and the sums split at a time.
FIRST_BITS, MORE_BITS, REFINED = 14, 8, 64


def walked(items: Column, limit: Column, divisible: bool) -> Column:
    """The greedy walk over items (size, groups) under a capacity: n (shards), filled (of the last), at, and cuts (offsets).

    With ``divisible`` an item of several groups may be cut anywhere.
    """
    at = lambda s: s["at"]
    state = lambda n, filled, at, cuts: F.struct(n.alias("n"), filled.alias("filled"), at.alias("at"), cuts.alias("cuts"))

    def step(s: Column, g: Column) -> Column:
        size = g["size"]
        fits = state(s["n"], s["filled"] + size, at(s) + size, s["cuts"])
        new = state(s["n"] + 1, size, at(s) + size, F.array_append(s["cuts"], at(s)))
        if divisible:
            over = F.greatest(F.ceil((s["filled"] + size) / limit).cast("long") - 1, F.lit(1).cast("long"))
            inner = F.transform(F.sequence(F.lit(1).cast("long"), over), lambda k: at(s) - s["filled"] + k * limit)
            parted = state((s["n"] + over).cast("int"), s["filled"] + size - over * limit, at(s) + size, F.concat(s["cuts"], inner))
            new = F.when(g["groups"] > 1, parted).otherwise(new)
        return F.when(s["filled"] + size <= limit, fits).otherwise(new)

    zero = F.lit(0).cast("long")
    return F.aggregate(items, state(F.lit(1), zero, zero, F.expr("cast(array() as array<bigint>)")), step)


def total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, g: s + g["size"])


def capacity(items: Column, shards: int, divisible: bool = False) -> Column:
    """Smallest capacity for which the greedy walk over items (size, groups, most) needs at most ``shards`` runs; 0 if empty.

    ``most`` is the size of an item's largest group, which no capacity may be below.
    """
    largest = F.transform(items, lambda g: g["most"] if divisible else g["size"])
    low = F.greatest(F.coalesce(F.array_max(largest), F.lit(0).cast("long")), F.ceil(total(items) / shards))

    def halve(s: Column, _: Column) -> Column:
        middle = s["low"] + F.expr("0L") + F.floor((s["high"] - s["low"]) / 2)
        fits = walked(s["items"], middle, divisible)["n"] <= shards
        return F.when(s["low"] >= s["high"], s).otherwise(
            F.struct(F.when(fits, s["low"]).otherwise(middle + 1).alias("low"), F.when(fits, middle).otherwise(s["high"]).alias("high"), s["items"].alias("items"))
        )

    # A greedy walk leaves less than the largest item free in each shard, so the answer is below low plus that item. Each
    # step halves the interval; it is closed after the number of bits of the total.
    high = F.least(F.greatest(total(items), low), low + F.coalesce(F.array_max(F.transform(items, lambda g: g["size"])), F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.struct(low.alias("low"), high.alias("high"), items.alias("items")), halve, lambda s: s["high"])


def doubtful(items: Column, enough: Column, needed: Column, shards: int) -> Column:
    """The largest items (start, size, bits), at most REFINED, of several groups that a cut may fall into.

    Cut j lies between the j-th cut of the divisible walk under the capacity needed and that under the one that is enough.
    """
    low, high = walked(items, needed, True)["cuts"], walked(items, enough, True)["cuts"]
    spans = F.transform(low, lambda x, j: F.struct(x.alias("low"), F.greatest(x, F.coalesce(F.get(high, j), total(items))).alias("high")))
    none = F.expr("cast(array() as array<struct<size:bigint,start:bigint,bits:int>>)")

    def step(s: Column, g: Column) -> Column:
        end = s["at"] + g["size"]
        met = (g["groups"] > 1) & F.exists(s["spans"], lambda p: (p["low"] < end) & (p["high"] > s["at"]))
        own = F.struct(g["size"].alias("size"), g["start"].alias("start"), g["bits"].alias("bits"))
        return F.struct(end.alias("at"), F.when(met, F.array_append(s["found"], own)).otherwise(s["found"]).alias("found"), s["spans"].alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("found"), spans.alias("spans"))
    found = F.aggregate(items, start, step, lambda s: s["found"])
    return F.slice(F.sort_array(found, asc=False), 1, REFINED)


def summed(groups: DataFrame, bits: int) -> DataFrame:
    """Items of groups (h, bytes) by the leading bits of h: start (least h), size, groups, most and bits."""
    cell = F.shiftright("h", 64 - bits)
    of = groups.groupBy(cell.alias("cell")).agg(F.min("h").alias("start"), F.sum("bytes").alias("size"), F.count("*").alias("groups"), F.max("bytes").alias("most"))
    return of.select("start", "size", "groups", "most", F.lit(bits).alias("bits"))


def group_cuts(groups: DataFrame, shards: int, first_bits: int = FIRST_BITS) -> tuple[int, list[int]]:
    """The smallest capacity for groups (h, bytes) in order of h, and the h at which new shards start, at most shards - 1.

    Only these numbers, and the places of at most REFINED items a round, reach the driver. The list of items has at most
    2 ** first_bits + REFINED * 2 ** MORE_BITS numbers more a round; a round splits each chosen item by MORE_BITS bits.
    """
    items = written(summed(groups, first_bits))
    while True:
        listed = written(items.agg(F.array_sort(F.collect_list(F.struct("start", "size", "groups", "most", "bits"))).alias("items")))
        enough, needed = listed.select(capacity(F.col("items"), shards), capacity(F.col("items"), shards, True)).first()
        if enough == needed:
            at = cuts(F.transform("items", lambda g: g["size"]), F.lit(enough), shards)
            return enough, listed.select(F.transform(at, lambda i: F.get(F.col("items"), i)["start"])).first()[0]
        split = listed.select(doubtful(F.col("items"), F.lit(enough), F.lit(needed), shards)).first()[0]
        parts = items.where(~F.col("start").isin([i["start"] for i in split]))
        for bits in sorted({i["bits"] for i in split}):
            cells = [i["start"] >> (64 - bits) for i in split if i["bits"] == bits]
            inside = groups.where(F.shiftright("h", 64 - bits).isin(cells))
            parts = parts.unionByName(summed(inside, min(64, bits + MORE_BITS)))
        items = written(parts)


def cuts(sizes: Column, limit: Column, shards: int) -> Column:
    """Positions (from 0, at most ``shards - 1``, rising) at which a new shard starts, none above the capacity ``limit``.

    A shard closes at its even share of what is left, but never so early that the rest would not fit.
    """
    last = F.size(sizes)
    # latest[j]: the first position from which the rest fits into j + 1 shards, found by filling from the end.
    latest = F.aggregate(
        F.reverse(sizes),
        F.struct(
            F.lit(0).cast("long").alias("filled"),
            last.alias("at"),
            F.expr("cast(array() as array<int>)").alias("starts"),
        ),
        lambda s, g: F.when(
            s["filled"] + g <= limit,
            F.struct((s["filled"] + g).alias("filled"), (s["at"] - 1).alias("at"), s["starts"].alias("starts")),
        ).otherwise(
            F.struct(g.alias("filled"), (s["at"] - 1).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))
        ),
        lambda s: s["starts"],
    )
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, g: s + g)

    def step(s: Column, g: Column) -> Column:
        left = F.lit(shards) - F.size(s["cuts"])  # shards that are not closed, the open one included
        # With left - 1 shards for the rest, the rest may start at latest[left - 2] or later; past the array's end it always fits.
        fits = F.coalesce(F.get(s["latest"], left - 2) <= s["at"], F.lit(True))
        even = 2 * (s["filled"] * left) + g * left > 2 * s["rest"]
        close = (left > 1) & (s["at"] > 0) & ((s["filled"] + g > s["limit"]) | (fits & even))
        return F.struct(
            F.when(close, F.array_append(s["cuts"], s["at"])).otherwise(s["cuts"]).alias("cuts"),
            F.when(close, g).otherwise(s["filled"] + g).alias("filled"),
            F.when(close, s["rest"] - s["filled"]).otherwise(s["rest"]).alias("rest"),
            (s["at"] + 1).alias("at"),
            s["latest"].alias("latest"),
            s["limit"].alias("limit"),
        )

    start = F.struct(
        F.expr("cast(array() as array<int>)").alias("cuts"),
        F.lit(0).cast("long").alias("filled"),
        total.alias("rest"),
        F.lit(0).alias("at"),
        latest.alias("latest"),
        limit.alias("limit"),
    )
    return F.aggregate(sizes, start, step, lambda s: s["cuts"])


def shard_documents(
    documents: DataFrame, shards: int = 8, first_bits: int = FIRST_BITS, rank_cells: int = 4096, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """Every document's shard under the law ``bytes``: sizes near equal, equal texts together, one row per input row.

    A document's size is its UTF-8 bytes plus 1 (null text: 1, as an empty one). Returns the id, size, text_crc32, law,
    shard, slot (gapless from 0 in each shard) and grown_shard (null under this law). Null ids are kept; repeated rows
    each get a slot of their own; an empty table gives an empty result; other columns of the input are left out. A group
    larger than an even share gets a shard that it fills alone if need be; shards can then be smaller or empty.

    ``rank_cells`` bounds the ranking: rows of a shard are spread by a hash of id and text over so many cells, counted
    first, and ranked inside their cell, so that one group of copies is never in one task.
    """
    body = text_of(documents, text)
    base = written(
        documents.select(
            documents[id].alias("id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(F.encode(body, "utf-8")).alias("crc"),
            F.xxhash64(body).alias("h"),
        )
    )
    _, starts = group_cuts(written(base.groupBy("h").agg(F.sum("size").alias("bytes"))), shards, first_bits)

    shard = F.lit(0)
    for first in starts:
        shard = shard + F.when(F.col("h") >= first, 1).otherwise(0)
    placed = base.select("*", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("id", "h"), F.lit(rank_cells)).cast("int").alias("rank_cell"))
    offsets = offsets_before(placed.groupBy("shard", "rank_cell").count(), ["shard"], "rank_cell", "count")
    within = Window.partitionBy("shard", "rank_cell").orderBy("h", "id", "size", "crc")
    return placed.join(offsets, ["shard", "rank_cell"]).select(
        F.col("id").alias(id),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
