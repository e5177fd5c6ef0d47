"""State comparison, matching and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.sources.shared import tasks_for


def state_diff(expected: DataFrame, actual: DataFrame, keys: list[str], row: str, show: int = 5) -> DataFrame:
    """keys, missing and unexpected of each table (``keys``) whose multisets of canonical rows differ.

    Lists hold at most ``show`` distinct rows that one side lacks altogether, so a pure difference of counts has two empty
    lists.
    """
    side = lambda rows, mine: rows.select(*keys, row, F.lit(int(mine)).alias("__e"), F.lit(int(not mine)).alias("__a"))
    held = side(expected, True).unionByName(side(actual, False)).repartition(tasks_for(expected, actual), *keys)
    both = held.groupBy(*keys, row).agg(F.sum("__e").alias("__e"), F.sum("__a").alias("__a")).where("__e <> __a")
    rank = F.row_number().over(Window.partitionBy(*keys, "__side").orderBy(row))
    side = F.when(F.col("__a") == 0, "missing").when(F.col("__e") == 0, "unexpected").otherwise("count")
    first = both.withColumn("__side", side).withColumn("__k", rank).where((F.col("__k") <= show) | (F.col("__side") == "count"))
    lists = lambda name: F.array_sort(F.collect_list(F.when(F.col("__side") == name, F.col(row))))
    return first.where((F.col("__side") != "count") | (F.col("__k") == 1)).groupBy(*keys).agg(lists("missing").alias("missing"), lists("unexpected").alias("unexpected"))


def state_changed(expected: DataFrame, actual: DataFrame) -> bool:
    """Whether the two multisets of rows differ."""
    return not (expected.exceptAll(actual).isEmpty() and actual.exceptAll(expected).isEmpty())


def changed_cells(before: DataFrame, after: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """keys, column, old and new of the cells (a map<string,string>) that differ between rows of one key."""
    pairs = before.select(*keys, F.col(cells).alias("__b")).join(after.select(*keys, F.col(cells).alias("__a")), keys)
    zipped = F.map_zip_with("__b", "__a", lambda k, x, y: F.when(~x.eqNullSafe(y), F.struct(x.alias("old"), y.alias("new"))))
    rows = pairs.select(*keys, F.explode(zipped).alias("column", "c")).where("c is not null")
    return rows.select(*keys, "column", "c.old", "c.new")


def state_mutations(before: DataFrame, after: DataFrame, keys: list[str], cells: str = "cells") -> DataFrame:
    """One mutation per changed cell of a kept row: put back to its old value."""
    return changed_cells(before, after, keys, cells).select(*keys, "column", F.col("new").alias("now"), F.col("old").alias("reverted"))


def diff_keys(gold: str, made: str):
    """Sorted keys whose values differ between two maps."""
    differing = F.map_filter(F.map_zip_with(gold, made, lambda k, x, y: ~x.eqNullSafe(y)), lambda k, v: v)
    return F.array_sort(F.map_keys(differing))


def gold_match(gold: DataFrame, made: DataFrame) -> DataFrame:
    """Each gold call with its best made call of the same episode and tool: exact, wrong arguments, or missing.

    ``gold``: episode_id, gold_idx, name, args (map). ``made``: episode_id, call_idx, name, args. Fewest differing keys
    win, then the earliest call.
    """
    g = gold.select("episode_id", "gold_idx", "name", F.col("args").alias("__g"))
    pairs = g.join(made.select("episode_id", "name", "call_idx", F.col("args").alias("__m")), ["episode_id", "name"], "left")
    pairs = pairs.withColumn("differing", F.when(F.col("call_idx").isNotNull(), diff_keys("__g", "__m")))
    best = pairs.groupBy("episode_id", "gold_idx", "name").agg(F.min(F.when(F.col("call_idx").isNotNull(), F.struct(F.size("differing").alias("n"), "call_idx", "differing"))).alias("b"))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("b.n") == 0, "exact").otherwise("arguments")
    return best.select("episode_id", "gold_idx", "name", kind.alias("kind"), F.col("b.call_idx").alias("call_idx"), F.coalesce("b.differing", F.expr("array()").cast("array<string>")).alias("differing"))


def aliases(cells: DataFrame) -> DataFrame:
    """alias and row_id for text values (of three or more characters) that name exactly one row.

    ``cells``: row_id, column, value; the id column is left out.
    """
    named = cells.where((F.col("column") != "id") & (F.length("value") >= 3)).select(S.ascii_key(F.col("value")).alias("alias"), "row_id")
    return named.groupBy("alias").agg(F.min("row_id").alias("row_id"), F.max("row_id").alias("__x")).where("row_id = __x").drop("__x")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], *, start: str = "start", end: str = "end", width: int) -> DataFrame:
    """The rows of ``left`` whose half-open interval meets one of ``right`` with the same keys; numbers or timestamps in seconds.

    Intervals are spread over time cells of ``width``, so the join is on keys and cell; null and empty intervals meet none.
    """
    cells = lambda d: d.where((F.col(start) < F.col(end))).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1e-9) / width))))
    b = cells(right.select(*keys, start, end)).select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), "__cell").distinct()
    a = cells(left.select(*keys, start, end).distinct())
    hit = a.join(b, [*keys, "__cell"]).where((F.col(start) < F.col("__e")) & (F.col("__s") < F.col(end))).select(*keys, start, end).distinct()
    return left.join(hit, [*keys, start, end], "left_semi")


def result_dependency(values: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """episode_id and depends: whether a later call uses a value first seen in an earlier good result.

    ``values``: episode_id, seq, side (argument or result), value; values among the user's facts do not count. The
    earliest result and latest argument of each value are aggregated first, so the join is one row per value.
    """
    rows = values if facts is None else values.join(facts.select("episode_id", "value").distinct(), ["episode_id", "value"], "left_anti")
    ends = rows.groupBy("episode_id", "value").agg(F.min(F.when(F.col("side") == "result", F.col("seq"))).alias("r"), F.max(F.when(F.col("side") == "argument", F.col("seq"))).alias("a"))
    uses = ends.groupBy("episode_id").agg(F.bool_or(F.coalesce(F.col("r") < F.col("a"), F.lit(False))).alias("depends"))
    return values.select("episode_id").distinct().join(uses, "episode_id", "left").select("episode_id", F.coalesce("depends", F.lit(False)).alias("depends"))


def skipped_steps(original: DataFrame, flipped: DataFrame, after: str) -> DataFrame:
    """Steps of the original trace, past the position in column ``after``, that the other trace never takes."""
    return original.where(F.col("seq") > F.col(after)).join(flipped.select("episode_id", "step").distinct(), ["episode_id", "step"], "left_anti")


def accept_results(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Results that fit their scheduled job (index, attempt, task_id, seed): the first arrival of each index, none stale."""
    fits = results.join(jobs.select("dataset_index", "attempt", "task_id", "seed"), ["dataset_index", "attempt", "task_id", "seed"], "left_semi")
    first = F.row_number().over(Window.partitionBy("dataset_index").orderBy("finished_at", "attempt"))
    return fits.withColumn("__k", first).where("__k = 1").drop("__k")


def committed_writes(calls: DataFrame, consent: str = "consent") -> DataFrame:
    """episode_id and writes: canonical name and arguments, without the consent argument, of good write calls in order."""
    rows = calls.where(F.col("write") & ~F.col("failed"))
    kept = S.canonical_map(F.map_filter(F.from_json("arguments", "map<string,string>"), lambda k, v: k != consent))
    return rows.select("episode_id", "msg_idx", "call_idx", F.concat_ws(" ", "name", kept).alias("w")).groupBy("episode_id").agg(
        F.array_sort(F.collect_list(F.struct("msg_idx", "call_idx", "w")))["w"].alias("writes")
    )


def failure_clusters(episodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Clusters of two or more failed episodes that agree in ``keys``: their number and first episode."""
    return episodes.groupBy(*keys).agg(F.count("*").alias("episodes"), F.min(order).alias("first")).where("episodes >= 2")


def sibling_ids(rows: DataFrame, show: int = 3) -> DataFrame:
    """id and the first ``show`` other ids of its table; only the first of each table are ranked and collected."""
    ids = rows.select("table", "id").distinct()
    ranked = ids.withColumn("k", F.row_number().over(Window.partitionBy("table").orderBy("id"))).where(F.col("k") <= show + 1)
    first = ranked.groupBy("table").agg(F.array_sort(F.collect_list("id")).alias("f"))
    return ids.join(first, "table").select("table", "id", F.slice(F.filter("f", lambda x: x != F.col("id")), 1, show).alias("others"))
