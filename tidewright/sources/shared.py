"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new temporary folder in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Rows that a task gets of a table dealt by key.
TASK_ROWS = 100_000


def tasks_for(*tables: DataFrame) -> int:
    """Partitions for rows dealt by key, by the number of rows: what a task sorts or groups does not grow with the tables."""
    least = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sum(t.count() for t in tables) // TASK_ROWS))


#: Whether Spark removes the shuffle files of a query at its end; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, path: str) -> None:
    """Writes df as Parquet. Its shuffle files go with the write, so those of successive tables do not add up on the disks.

    The setting holds for the write only: elsewhere a DataFrame may run twice, and would have to shuffle again.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors.

    Tables stay until the folder is cleaned, as checkpoints do, or until they are discarded: a query is lazy, so what it reads
    must outlive the call.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    store(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing will read again: all that reads them is written itself."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Discards, at its end, all tables that were made in it; what they led to must be written elsewhere by then."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        discard(*made)
