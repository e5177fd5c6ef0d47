"""Journals of JSON lines as a data source: appended under a commit protocol, read whole or as a stream.

A journal is a folder of segments, which tasks write, and of numbered commits, each a small file that names its segments with
their lines, bytes and SHA-256. A commit is one exclusive creation of a file, so an append is there as a whole or not at all: what a
lost task or driver has left is named by no commit and never read. A stream's offset is the number of the last commit it has
read. Journals that others write as one file may end in a torn line, which ``lines_of`` leaves out.

    spark.dataSource.register(JournalSource)
    lines.write.format("journal").mode("append").save(folder)  # lines: value string
    spark.readStream.format("journal").load(folder)
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "commit long, segment string, line long, value string"


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def commits(path: str) -> list[dict]:
    """The commits of a journal in order; an empty list for a new one."""
    from pyarrow import fs

    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    out = []
    for info in sorted((x for x in found if x.base_name.endswith(".json")), key=lambda x: x.base_name):
        with store.open_input_stream(info.path) as file:
            out.append({"commit": int(info.base_name[:-5]), **json.loads(file.read())})
    return out


def cursor(path: str) -> dict:
    """Where a journal stands: its last commit, lines and bytes, and a digest over the digests of its segments."""
    segments = [(c["commit"], s) for c in commits(path) for s in c["segments"]]
    digest = hashlib.sha256("".join(f"{n}:{s['sha256']}\n" for n, s in segments).encode()).hexdigest()
    return {"commit": max((n for n, _ in segments), default=0), "lines": sum(s["lines"] for _, s in segments), "bytes": sum(s["bytes"] for _, s in segments), "sha256": digest}


def _commit(path: str, segments: list[dict], key: str | None = None) -> None:
    """Adds a commit after the last one; one of a key that is there already is not added again."""
    store, root = _store(path)
    store.create_dir(f"{root}/_commits", recursive=True)
    there = commits(path)
    if key is not None and any(c.get("key") == key for c in there):
        return
    number = there[-1]["commit"] + 1 if there else 1
    temporary, final = f"{root}/_commits/.{uuid.uuid4().hex}", f"{root}/_commits/{number:012d}.json"
    with store.open_output_stream(temporary) as file:
        file.write(json.dumps({"key": key, "segments": segments}).encode())
    store.move(temporary, final)


def _segment(path: str, rows: Iterator) -> dict:
    """Writes the values of rows as a new segment."""
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    name, lines, size, digest = f"{uuid.uuid4().hex}.jsonl", 0, 0, hashlib.sha256()
    with store.open_output_stream(f"{root}/{name}") as file:
        for row in rows:
            if row[0] is None:
                continue
            line = (row[0].replace("\n", " ") + "\n").encode()
            file.write(line)
            digest.update(line)
            lines, size = lines + 1, size + len(line)
    return {"segment": name, "lines": lines, "bytes": size, "sha256": digest.hexdigest()}


@dataclass
class Written(WriterCommitMessage):
    segment: dict


@dataclass
class Segment(InputPartition):
    commit: int
    segment: dict


def _read(path: str, part: Segment) -> Iterator[tuple]:
    store, root = _store(path)
    name = part.segment["segment"]
    with store.open_input_stream(f"{root}/{name}") as file:
        held, number = b"", 0
        while block := file.read(1 << 20):
            *whole, held = (held + block).split(b"\n")
            for line in whole:
                yield part.commit, name, number, line.decode()
                number += 1


def _parts(path: str, after: int, to: int | None = None) -> list[Segment]:
    return [Segment(c["commit"], s) for c in commits(path) if c["commit"] > after and (to is None or c["commit"] <= to) for s in c["segments"] if s["lines"]]


class JournalReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Segment]:
        return _parts(self.path, 0) or [Segment(0, {})]

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _read(self.path, partition) if partition.segment else iter(())


class JournalStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commit": 0}

    def latestOffset(self) -> dict:
        return {"commit": max((c["commit"] for c in commits(self.path)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return _parts(self.path, start["commit"], end["commit"])

    def read(self, partition: Segment) -> Iterator[tuple]:
        return _read(self.path, partition)


class _Appends:
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        return Written(_segment(self.path, iterator))

    def _abandon(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in filter(None, messages):
            store.delete_file(f"{root}/{m.segment['segment']}")


class JournalWriter(_Appends, DataSourceWriter):
    def commit(self, messages: list) -> None:
        _commit(self.path, [m.segment for m in messages if m is not None])

    def abort(self, messages: list) -> None:
        self._abandon(messages)


class JournalStreamWriter(_Appends, DataSourceStreamWriter):
    def __init__(self, path: str, name: str):
        super().__init__(path)
        self.name = name

    def commit(self, messages: list, batchId: int) -> None:
        _commit(self.path, [m.segment for m in messages if m is not None], f"{self.name}/{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self._abandon(messages)


class JournalSource(DataSource):
    """Options: path; for streams also ``writer``, the name under which batches are committed once."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> JournalReader:
        return JournalReader(self.options["path"])

    def streamReader(self, schema) -> JournalStream:
        return JournalStream(self.options["path"])

    def writer(self, schema, overwrite: bool) -> JournalWriter:
        if overwrite:
            raise ValueError("a journal is appended to")
        return JournalWriter(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> JournalStreamWriter:
        return JournalStreamWriter(self.options["path"], self.options.get("writer", "stream"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file and value of the whole lines of JSON-lines files; a torn line, which has no end or is no JSON, is left out."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.where(F.try_parse_json("value").isNotNull())


def export(lines: DataFrame, path: str, each: int = 65_536) -> None:
    """The lines (commit, segment, line, value) as texts of JSON arrays, ``each`` lines or fewer in each, under Spark's commit protocol."""
    held = lines.groupBy("commit", "segment", F.floor(F.col("line") / each).alias("__run")).agg(F.array_sort(F.collect_list(F.struct("line", "value")))["value"].alias("v"))
    held.select(F.concat(F.lit("["), F.array_join("v", ","), F.lit("]")).alias("value")).write.mode("errorifexists").text(path)
