"""Stateful streams: scheduled changes, breakers and contiguous acknowledgements, each with a batch twin elsewhere.

The batch twins are worlds.apply_events, episodes.rolling_breaker and selection.contiguous_prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Acknowledgements(StatefulProcessor):
    """Per worker the length of the gapless prefix, and the indices beyond it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.position = handle.getValueState("position", "position long")
        self.waiting = handle.getMapState("waiting", "index long", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.position.get()[0] if self.position.exists() else 0
        before = at
        for frame in rows:
            for i in frame["index"]:
                if i >= at:
                    self.waiting.updateValue((int(i),), (True,))
        while self.waiting.containsKey((at,)):
            self.waiting.removeKey((at,))
            at += 1
        self.position.update((at,))
        yield pd.DataFrame({"worker": [key[0]], "position": [at]} if at != before else {"worker": [], "position": []})

    def close(self) -> None:
        pass


def acknowledged(acks: DataFrame) -> DataFrame:
    """A stream of (worker, position) from a stream of (worker, index); late and repeated indices change nothing."""
    return acks.groupBy("worker").transformWithStateInPandas(Acknowledgements(), outputStructType="worker long, position long", outputMode="update", timeMode="none")


class Breaker(StatefulProcessor):
    """Per key the flags of the last ``window`` rows; emits a row when the rate of a full window passes the limit."""

    def __init__(self, window: int, limit: float):
        self.window, self.limit = window, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", "flags array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.flags.get()[0]) if self.flags.exists() else []
        out = []
        for frame in rows:
            for r in frame.sort_values("seq").itertuples():
                held = [*held, int(r.flag)][-self.window :]
                rate = sum(held) / len(held)
                if len(held) == self.window and rate > self.limit:
                    out.append((key[0], r.seq, rate))
        self.flags.update((held,))
        yield pd.DataFrame(out, columns=["key", "seq", "rate"])

    def close(self) -> None:
        pass


def tripped(flags: DataFrame, *, window: int = 40, limit: float = 0.25) -> DataFrame:
    """A stream of trips (key, seq, rate) from a stream of (key, seq, flag)."""
    return flags.groupBy("key").transformWithStateInPandas(Breaker(window, limit), outputStructType="key long, seq long, rate double", outputMode="append", timeMode="none")


class ScheduledChanges(StatefulProcessor):
    """Per row (table, row_id) the value of each cell after the changes due so far, the last by (at, event id)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "column string", "at long, event string, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for frame in rows:
            for r in frame.itertuples():
                old = self.cells.getValue((r.column,)) if self.cells.containsKey((r.column,)) else None
                if old is None or (r.at, r.event_id) > (old[0], old[1]):
                    self.cells.updateValue((r.column,), (int(r.at), r.event_id, r.value))
                    out.append((key[0], key[1], r.column, r.value))
        yield pd.DataFrame(out, columns=["table", "row_id", "column", "value"])

    def close(self) -> None:
        pass


def current_cells(changes: DataFrame, now: int) -> DataFrame:
    """A stream of cell values from a stream of changes (table, row_id, column, at, event_id, value) that are due at ``now``."""
    due = changes.where(F.col("at") <= now)
    return due.groupBy("table", "row_id").transformWithStateInPandas(ScheduledChanges(), outputStructType="table string, row_id string, column string, value string", outputMode="update", timeMode="none")


def windowed_counts(events: DataFrame, *, time: str = "ts", key: str = "event_type", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events per tumbling window and key, with a watermark; works on a stream or a table."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")
