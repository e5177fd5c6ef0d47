"""Helpers of the training-data operators: shared storage, identifiers, word rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.shared import discard, passing, shared_folder, store, written

__all__ = ["SPACE", "WORD", "discard", "offsets_before", "passing", "shared_folder", "store", "text_of", "word_count", "written"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words as a long, 0 for null or empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offsets_before(counts: DataFrame, keys: list[str], cell: str, amount: str, group_bits: int = 7) -> DataFrame:
    """keys, cell and offset: the sum of ``amount`` over the lower cells of the same keys.

    ``counts`` has one row for each keys and cell (a non-negative int). Sums run over groups of 2 ** group_bits cells first,
    then inside each group, so the cells of one key are spread over tasks.
    """
    grouped = counts.withColumn("__group", F.shiftright(cell, group_bits))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    whole = grouped.groupBy(*keys, "__group").agg(F.sum(amount).alias("__sum"))
    whole = whole.select(*keys, "__group", F.coalesce(F.sum("__sum").over(before(*keys).orderBy("__group")), zero).alias("__before"))
    inside = F.coalesce(F.sum(amount).over(before(*keys, "__group").orderBy(cell)), zero)
    return grouped.withColumn("__inside", inside).join(whole, [*keys, "__group"]).select(*keys, cell, (F.col("__before") + F.col("__inside")).alias("offset"))
