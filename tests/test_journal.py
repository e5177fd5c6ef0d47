"""Journals under failures and restarts, and mini-batches that leave a stream as they arrive."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import contracts
from tidewright.sources import journal
from tidewright.streaming.ready import ready_stream, taken


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(journal.JournalSource)
    return spark


def append(spark, values: list, path: str) -> None:
    spark.createDataFrame([(v,) for v in values], "value string").repartition(2).write.format("journal").mode("append").save(path)


def read(spark, path: str) -> list[str]:
    return sorted(r["value"] for r in spark.read.format("journal").load(path).collect())


def test_appends_are_whole_or_not_at_all(source, tmp_path):
    path = str(tmp_path / "j")
    assert journal.cursor(path) == {"commit": 0, "lines": 0, "bytes": 0, "sha256": journal.cursor(path)["sha256"]}
    append(source, ['{"a": 1}', '{"a": 2}', None, "two\nlines"], path)
    first = journal.cursor(path)
    assert first["commit"] == 1 and first["lines"] == 3 and read(source, path) == ["two lines", '{"a": 1}', '{"a": 2}']
    (tmp_path / "j" / "torn.jsonl").write_text('{"a": 9}\n{"cut')  # of a lost task: named by no commit
    assert read(source, path) == ["two lines", '{"a": 1}', '{"a": 2}'] and journal.cursor(path) == first
    with pytest.raises(Exception, match="boom"):
        bad = source.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("boom"))).otherwise("x").alias("value"))
        bad.write.format("journal").mode("append").save(path)
    assert journal.cursor(path) == first
    append(source, ['{"a": 3}'], path)
    assert journal.cursor(path)["lines"] == 4 and journal.cursor(path)["sha256"] != first["sha256"]


def test_empty_journal_and_foreign_files(source, tmp_path):
    assert read(source, str(tmp_path / "none")) == []
    (tmp_path / "m.jsonl").write_text('{"a": 1}\n{"b": 2}\n{"cut": ')
    assert journal.lines_of(source, str(tmp_path / "m.jsonl")).count() == 2


def test_export_is_arrays(source, tmp_path):
    path = str(tmp_path / "j")
    append(source, [json.dumps({"n": i}) for i in range(25)], path)
    journal.export(source.read.format("journal").load(path), str(tmp_path / "out"), each=4)
    arrays = [json.loads(r["value"]) for r in source.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x["n"] for a in arrays for x in a) == list(range(25)) and max(map(len, arrays)) == 4


def test_a_stream_restarts_without_loss_or_repeats(source, tmp_path):
    """Read, appended to and read again from its checkpoint; a batch that is committed again is not doubled."""
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run() -> None:
        lines = source.readStream.format("journal").load(path).select("value")
        lines.writeStream.format("journal").option("checkpointLocation", mark).option("writer", "w").trigger(availableNow=True).start(out).awaitTermination()

    append(source, ["a", "b"], path)
    run()
    assert read(source, out) == ["a", "b"]
    append(source, ["c"], path)
    append(source, ["d", "e"], path)
    run()
    run()
    assert read(source, out) == ["a", "b", "c", "d", "e"]
    before = journal.cursor(out)
    journal._commit(out, [], "w/0")
    assert journal.cursor(out) == before and len(journal.commits(out)) == len({c["key"] for c in journal.commits(out)})


def test_taken():
    assert taken([1, 2, 3], 5, 2) == ([[1, 2]], [3], 3)
    assert taken([1, 2, 3], 3, 2) == ([[1, 2], [3]], [], 0)
    assert taken([1, 2, 3], 0, 2) == ([], [1, 2, 3], 0)


@pytest.mark.parametrize("order", [1, 2])
def test_ready_stream_equals_the_batch_operator(spark, tmp_path, order):
    """Results in any order of arrival, some twice, in files that arrive one by one; some batches never complete."""
    rng = random.Random(order)
    jobs = [(b, 100 * b + i) for b, n in ((1, 10), (2, 7), (3, 23), (4, 6)) for i in range(n)]
    came = [j for j in jobs if j != (4, 402)]
    rng.shuffle(came)
    rows = [(b, i, k, sum(x == b for x, _ in jobs)) for k, (b, i) in enumerate(came)]
    schema = "batch long, dataset_index long, finished_at long, wanted long"
    again = rng.sample(rows, 8)
    for k in range(0, len(rows), 9):
        late = [r for r in again if r[2] < k][:3]
        spark.createDataFrame(rows[k : k + 9] + late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ready_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 7)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["batch"], r["dataset_index"]): r["minibatch"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    results = spark.createDataFrame(rows, schema)
    want = contracts.ready_minibatches(results, spark.createDataFrame(jobs, "batch long, dataset_index long"), 7).collect()
    assert got == {(r["batch"], r["dataset_index"]): r["minibatch"] for r in want} and len(got) == 40
