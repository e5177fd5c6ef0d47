"""Curriculum state per task: the last two group rates at its level, promotion when both reach the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def advance(level: int, rates: list[float], rate: float, levels: int, threshold: float) -> tuple[int, list[float]]:
    """State after one group of the task's level."""
    rates = [*rates, rate][-2:]
    if len(rates) == 2 and min(rates) >= threshold and level < levels:
        return level + 1, []
    return level, rates


def promote(groups: DataFrame, *, levels: int, threshold: float = 0.6) -> DataFrame:
    """task_id and level after all groups (task_id, arrival, rate) in order of arrival; the batch twin of the stream.

    A task's groups are folded in Spark: sorted into an array and reduced.
    """
    held = groups.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("arrival", "rate"))).alias("g"))
    start = F.struct(F.lit(0).alias("level"), F.lit(None).cast("double").alias("last"))

    def step(s: Column, x: Column) -> Column:
        up = F.coalesce((s["last"] >= threshold) & (x["rate"] >= threshold) & (s["level"] < levels), F.lit(False))
        return F.struct((s["level"] + up.cast("int")).alias("level"), F.when(~up, x["rate"]).alias("last"))

    return held.select("task_id", F.aggregate("g", start, step, lambda s: s["level"]).alias("level"))


def prefix(snapshots: Column, turns: Column, level: Column, shares: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> Column:
    """How many snapshots to replay at a level: min(n, max(1, round(turns * (1 - share)))), half to even."""
    share = F.get(F.array(*[F.lit(s) for s in shares]), level)
    return F.least(snapshots, F.greatest(F.lit(1), F.bround(turns * (1 - share), 0))).cast("int")


class CurriculumProcessor(StatefulProcessor):
    """Keeps (level, rates) per task; emits task_id and level for every promotion. Groups of other levels are ignored."""

    def __init__(self, levels: int, threshold: float):
        self.levels, self.threshold = levels, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "level int, rates array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        level, rates = self.state.get() if self.state.exists() else (0, [])
        rates, moved = list(rates), []
        for frame in rows:
            for r in frame.sort_values("arrival").itertuples():
                if r.level != level:
                    continue
                new, rates = advance(level, rates, r.rate, self.levels, self.threshold)
                if new != level:
                    moved.append((key[0], new))
                level = new
        self.state.update((level, rates))
        yield pd.DataFrame(moved, columns=["task_id", "level"])

    def close(self) -> None:
        pass


def promotions(groups: DataFrame, *, levels: int, threshold: float = 0.6) -> DataFrame:
    """A stream of promotions from a stream of groups (task_id, level, arrival, rate); needs the RocksDB state store."""
    return groups.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=CurriculumProcessor(levels, threshold), outputStructType="task_id long, level int", outputMode="append", timeMode="none"
    )
