from __future__ import annotations

from tidewright.operators import episodes, selection
from tidewright.streaming import curriculum, events


def run(spark, frame, build, name, tmp_path, files=3):
    """All rows that a stream over the frame's files emits."""
    folder = str(tmp_path / name)
    frame.repartition(files).write.parquet(folder)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = build(stream)
    query = out.writeStream.format("memory").queryName(name).outputMode("update" if name in ("acks", "cells") else "append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_acknowledgements_equal_the_batch(spark, tmp_path):
    acks = spark.createDataFrame([(w, i) for w in range(3) for i in range(12) if (w, i) not in ((1, 7), (2, 0))] + [(0, 3)], "worker long, index long")
    got = {}
    for r in run(spark, acks, events.acknowledged, "acks", tmp_path):
        got[r["worker"]] = max(got.get(r["worker"], 0), r["position"])
    want = {r["worker"]: r["position"] for r in selection.contiguous_prefix(acks, "worker", "index").collect()}
    assert {w: got.get(w, 0) for w in want} == want == {0: 12, 1: 7, 2: 0}


def test_breaker_trips(spark, tmp_path):
    flags = spark.createDataFrame([(1, i, i >= 10) for i in range(30)], "key long, seq long, flag boolean")
    rows = run(spark, flags.coalesce(1), lambda s: events.tripped(s, window=10, limit=0.5), "trips", tmp_path, files=1)
    batch = episodes.rolling_breaker(flags, ["seq"], "flag", window=10, limit=0.5).where("tripped").collect()
    assert sorted(r["seq"] for r in rows) == sorted(r["seq"] for r in batch)


def test_scheduled_changes(spark, tmp_path):
    rows = [("t", "1", "a", 5, "e1", "x"), ("t", "1", "a", 9, "e2", "y"), ("t", "1", "a", 9, "e0", "z"), ("t", "1", "a", 50, "e9", "late")]
    frame = spark.createDataFrame(rows, "table string, row_id string, column string, at long, event_id string, value string")
    out = run(spark, frame, lambda s: events.current_cells(s, 30), "cells", tmp_path)
    assert "y" in {r["value"] for r in out} and "late" not in {r["value"] for r in out}


def test_curriculum_promotes(spark, tmp_path):
    groups = spark.createDataFrame([(1, 0, i, 0.75) for i in range(4)] + [(1, 1, 10, 1.0), (2, 0, 0, 0.1)], "task_id long, level int, arrival long, rate double")
    out = run(spark, groups.coalesce(1), lambda s: curriculum.promotions(s, levels=3), "promotions", tmp_path, files=1)
    assert [(r["task_id"], r["level"]) for r in out] == [(1, 1)]


def test_windowed_counts_as_a_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert events.windowed_counts(table).agg({"n": "sum"}).first()[0] == table.count()
