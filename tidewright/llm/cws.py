"""Document fingerprints by consistent weighted sampling, in Spark expressions only.

A document's terms are its lower-cased pairs of neighbouring words, weighted by how often they occur. Sample k of a term
with weight S draws r and c from Gamma(2, 1) and b uniformly, all from a hash of (term, k); t = floor(ln S / r + b) and
ln a = ln c - r (t - b) - r; the term of least a and its t are the k-th element of the signature. Two documents share an
element with probability equal to the generalised Jaccard similarity of their weights, so the share of equal elements
estimates it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, text_of

SAMPLES = 24
#: ln a is kept in steps of 2**-24 above this floor, in the upper half of a long; the lower half names term and t.
_FLOOR, _STEPS = 64.0, 1 << 24


def gamma_table(size: int = 256) -> list[float]:
    """Quantiles of Gamma(2, 1) at the middles of ``size`` equal steps: solves 1 - (1 + r) exp(-r) = p."""
    out = []
    for i in range(size):
        p, low, high = (i + 0.5) / size, 0.0, 40.0
        for _ in range(60):
            r = (low + high) / 2
            low, high = (r, high) if 1 - (1 + r) * math.exp(-r) < p else (low, r)
        out.append(low)
    return out


def counted_terms(text: Column) -> Column:
    """Sorted hashes of the text's word pairs.

    The last word is a term by itself, so texts of one word, and empty ones, have a term too.
    """
    words = F.split(F.lower(text), SPACE)
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, 2, F.size(words)).alias("b"))
    return F.sort_array(F.transform(pairs, lambda p: F.xxhash64(p["a"], p["b"])))


def _samples(term: Column, count: Column) -> list[Column]:
    """For each k a long that orders by a and names the term and t."""
    table = F.array(*[F.lit(x) for x in gamma_table()])
    log_count = F.ln(count.cast("double"))
    out = []
    for k in range(SAMPLES):
        h = F.xxhash64(term, F.lit(k))
        part = lambda low, bits, h=h: F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << bits) - 1))
        r = F.get(table, part(0, 8).cast("int"))
        b = (part(8, 16) + 0.5) / float(1 << 16)
        c = -F.ln((part(24, 20) + 0.5) * (part(44, 20) + 0.5) / float(1 << 40))
        t = F.floor(log_count / r + b)
        log_a = F.ln(c) - r * (t - b + 1)
        rank = F.least(F.greatest(((log_a + _FLOOR) * _STEPS).cast("long"), F.lit(0)), F.lit((1 << 31) - 1))
        name = term.bitwiseXOR(t * 40503).bitwiseAND(F.lit((1 << 32) - 1))
        out.append(F.shiftleft(rank, 32).bitwiseOR(name))
    return out


def signatures(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key and signature (array of SAMPLES longs) of every row; ``key`` must name a row and keep rows where they are."""
    sorted_terms = rows.select(*key, counted_terms(F.col(text)).alias("s")).withColumn(
        "at", F.expr("filter(sequence(0, size(s) - 1), i -> i = 0 or get(s, i) <> get(s, i - 1))")
    )
    runs = sorted_terms.select(
        *key, "s", F.inline(F.arrays_zip(F.col("at").alias("first"), F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("s"))).alias("next")))
    )
    terms = runs.select(*key, F.get("s", F.col("first")).alias("term"), (F.col("next") - F.col("first")).alias("n"))
    low = F.lit((1 << 32) - 1)
    least = terms.groupBy(*key).agg(*[F.min(x).alias(f"k{i}") for i, x in enumerate(_samples(F.col("term"), F.col("n")))])
    return least.select(*key, F.array(*[F.col(f"k{i}").bitwiseAND(low) for i in range(SAMPLES)]).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal elements of two signatures."""
    return sum(((F.get(a, i) == F.get(b, i)).cast("int") for i in range(SAMPLES)), F.lit(0)) / float(SAMPLES)


def hexadecimal(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _boundaries(documents: DataFrame, id: str, rows_per_range: int, most: int) -> list:
    """Ids at which the ranges of an even split start, the first document's included: at most ``most`` numbers.

    A null id is the first document's.
    """
    n, empty, least = documents.agg(F.count("*"), F.count(F.when(documents[id].isNull(), 1)), F.min(id)).first()
    ranges = max(1, min(most, n // rows_per_range))
    if ranges == 1:
        return [None if empty else least]
    inner = [i / ranges for i in range(1, ranges)]
    found = documents.agg(F.percentile_approx(id, F.array(*[F.lit(x) for x in inner]), F.lit(8 * most if ranges > 1000 else 10_000))).first()[0]
    return [None if empty else least, *sorted(x for x in set(found or ()) if empty or x > least)]


def with_next(documents: DataFrame, text: str = "text", id: str = "doc_id", rows_per_range: int = 1024, most: int = 1 << 16) -> DataFrame:
    """range, row, main, id, text and next_text: each document with the text of the next by ascending id, the last with the first's.

    Texts are dealt once, by ranges of ids; the first document of a range also goes to the range before it (main false).
    The ranges start at ids of the table itself: at most ``most`` of them, whatever the size.
    """
    starts = _boundaries(documents, id, rows_per_range, most)
    tail = F.array(*[F.lit(x).cast("long") for x in starts[1:]]) if len(starts) > 1 else F.expr("cast(array() as array<bigint>)")
    steps = len(starts).bit_length()
    # Binary search: the number of starts, after the first, that are not above the id.
    place = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("low"), F.lit(len(starts) - 1).alias("high"), F.col("id").alias("id")),
        lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(
            F.when(
                F.get(tail, F.shiftright(s["low"] + s["high"], 1)) <= s["id"],
                F.struct((F.shiftright(s["low"] + s["high"], 1) + 1).alias("low"), s["high"].alias("high"), s["id"].alias("id")),
            ).otherwise(F.struct(s["low"].alias("low"), F.shiftright(s["low"] + s["high"], 1).alias("high"), s["id"].alias("id")))
        ),
        lambda s: s["low"],
    )
    rows = documents.select(documents[id].cast("long").alias("id"), text_of(documents, text).alias("text"))
    rows = rows.select("id", "text", F.when(F.col("id").isNull(), 0).otherwise(place).alias("range"))
    first = F.when(F.col("range") == 0, F.col("id").eqNullSafe(F.lit(starts[0]).cast("long"))).otherwise(F.get(tail, F.col("range") - 1) == F.col("id"))
    at = lambda r, main: F.struct(r.cast("int").alias("range"), F.lit(main).alias("main"))
    before = F.when(F.col("range") == 0, len(starts) - 1).otherwise(F.col("range") - 1)
    dealt = rows.select("id", "text", F.inline(F.when(first, F.array(at(F.col("range"), True), at(before, False))).otherwise(F.array(at(F.col("range"), True)))))
    order = Window.partitionBy("range").orderBy(F.col("main").desc(), F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    return dealt.select("range", F.row_number().over(order).alias("row"), "main", "id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprints(documents: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, signature, and the signatures of the edited text and of the next document, for every row.

    Null texts count as empty; ids are whole numbers, and what is none counts as null; null ids come first; repeated rows follow each other and each get a row; a lone document
    is its own next; an empty table gives an empty result; other columns are left out. The edited text replaces the last
    half of the code points by the first as many of the next document.
    """
    paired = with_next(documents, text, id)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    paired = paired.select("range", "row", "main", "id", n.cast("long").alias("n_chars"), "text", F.when(F.col("main"), edited).alias("edited"))
    facts = ["range", "row", "main", "id", "n_chars", "edited_sha256"]
    both = paired.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    versions = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))
    spread = both.select(*facts, F.inline(versions)).where("body is not null")
    signed = signatures(spread, [*facts, "version"], "body")
    wide = signed.groupBy(*facts).agg(F.max(F.when(F.col("version") == 0, F.col("signature"))).alias("signature"), F.max(F.when(F.col("version") == 1, F.col("signature"))).alias("edited_signature"))
    order = Window.partitionBy("range").orderBy("row")
    out = wide.select("*", F.lead("signature").over(order).alias("next_signature")).where("main")
    return out.select(F.col("id").alias(id), "n_chars", "edited_sha256", "signature", "edited_signature", "next_signature")
