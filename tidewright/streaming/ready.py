"""Mini-batches of results as a stream: emitted as soon as enough have arrived, once each."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def taken(waiting: list[int], left: int, size: int) -> tuple[list[list[int]], list[int], int]:
    """The mini-batches that can go, what waits on, and how many results are still wanted: the last may be smaller than ``size``."""
    out = []
    while left and len(waiting) >= min(size, left):
        n = min(size, left)
        out.append(waiting[:n])
        waiting, left = waiting[n:], left - n
    return out, waiting, left


class ReadyProcessor(StatefulProcessor):
    """Keeps, per key, the results that wait, how many are wanted yet, the next mini-batch's number, and which results came."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "waiting array<bigint>, wanted bigint, number bigint")
        self.seen = handle.getMapState("seen", "dataset_index long", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.state.get() if self.state.exists() else None, []
        for frame in rows:
            waiting, left, number = (list(held[0]), held[1], held[2]) if held else ([], int(frame["wanted"].iloc[0]), 0)
            for r in frame.sort_values(["finished_at", "dataset_index"]).itertuples():
                if self.seen.containsKey((r.dataset_index,)):
                    continue
                self.seen.updateValue((r.dataset_index,), (True,))
                waiting.append(int(r.dataset_index))
            gone, waiting, left = taken(waiting, left, self.size)
            out += [(key[0], i, number + k) for k, indices in enumerate(gone) for i in indices]
            held = (waiting, left, number + len(gone))
        self.state.update(held)
        yield pd.DataFrame(out, columns=["batch", "dataset_index", "minibatch"])

    def close(self) -> None:
        pass


def ready_stream(results: DataFrame, size: int) -> DataFrame:
    """A stream of (batch, dataset_index, minibatch) from a stream of results (batch, dataset_index, finished_at, wanted).

    ``wanted`` is how many results of the batch shall go in all: its jobs, or a number of them for an epoch. Results go in order of
    arrival, one micro-batch before the next, ``size`` together; the last mini-batch may be smaller. A result that comes again, late
    or twice, is dropped, and so are those beyond what is wanted. The state of a key is the indices that came; needs the
    RocksDB state store.
    """
    return results.groupBy("batch").transformWithStateInPandas(
        statefulProcessor=ReadyProcessor(size), outputStructType="batch long, dataset_index long, minibatch long", outputMode="append", timeMode="none"
    )
