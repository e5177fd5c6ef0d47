"""Quality, mixing and sharding against plain loops."""

from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.llm import mixing, quality, sharding


def targets(sizes: dict, weights=(1, 2, 3), times=3) -> dict:
    """Shares by repeated resharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        share = {s: rest * weight[s] / max(1, sum(weight[x] for x in free)) for s in free}
        over = [s for s in free if share[s] >= times * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(times * sizes[s]) for s in over}


def test_op5_on_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    frame = docs.select("doc_id", "source", "text").toPandas().set_index("doc_id")
    out = mixing.mix_documents(docs).toPandas()
    assert sorted(out.doc_id) == sorted(frame.index)
    assert list(out["size"]) == [len(frame.text[i].split()) for i in out.doc_id]
    sizes = frame.text.str.split().str.len().groupby(frame.source).sum().to_dict()
    want = targets(sizes)
    taken = defaultdict(int)
    for r in out.itertuples():
        s = frame.source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-6
    again = mixing.mix_documents(docs).toPandas()
    assert dict(zip(out.doc_id, out.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_op5_stops_at_three_times_the_source(spark):
    docs = spark.createDataFrame([(i, "w " * (5 if s != "big" else 400), s) for i, s in enumerate(["a", "b", "big", "big", None, "c"])], "doc_id long, text string, source string")
    out = mixing.mix_documents(docs).toPandas()
    want = targets({"a": 5, "b": 5, "big": 800, "c": 5, None: 5})
    for r in out.itertuples():
        s = {0: "a", 1: "b", 2: "big", 3: "big", 4: None, 5: "c"}[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size


def mix(rows: list[tuple], block: int, weights=(1, 2, 3), epochs=3) -> dict:
    """Words taken of each (id, source, text), by laying every word and every block in a loop."""
    sizes: Counter = Counter()
    for _, source, text in rows:
        sizes[source] += len(text.split())
    want = targets(dict(sizes))
    names = sorted((x for x in sizes if x is not None), key=str.encode) + ([None] if None in sizes else [])
    owned, points, edges = Counter(), -(-sum(sizes.values()) // block), []
    for s in names:
        edges.append((edges[-1] if edges else 0) + want[s] / sum(want.values()))
    for i in range(points):
        x = i * mixing.GOLDEN % 1
        owned[names[next(k for k, e in enumerate(edges) if x < e or k == len(edges) - 1)]] += 1
    taken: dict = defaultdict(int)
    for s in names:
        h = lambda i, t: xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(struct.pack("<q", i), 42))
        order = sorted((h(i, t), i, t) for i, x, t in rows if x == s)
        words = [i for _, i, t in order for _ in t.split()] * epochs
        for rank in range(max(owned[s], -(-round(want[s]) // block))):
            for i in words[rank * block : min((rank + 1) * block, round(want[s]))]:
                taken[i] += 1
    return taken


@pytest.mark.parametrize("block", [3, 7, 256])
def test_op5_equals_a_loop(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, ["a", "b", "c", "d", None][min(4, int(rng.exponential(1.2)))], " ".join("w" * int(k) for k in rng.integers(1, 5, int(rng.integers(0, 30))))) for i in range(120)]
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_words=block, cells=16).collect()
    want = mix(rows, block)
    assert len(out) == len(rows) and {r["doc_id"]: r["taken"] for r in out} == {i: want[i] for i, _, _ in rows}


def test_op5_repeated_rows_share_the_words_of_their_place(spark):
    docs = spark.createDataFrame([(1, "a", "one two three")] * 500 + [(2, "b", "four " * 900), (3, "c", "five " * 30)], "doc_id long, source string, text string")
    out = mixing.mix_documents(docs, block_words=16).toPandas()
    assert len(out) == 502 and out[out.doc_id == 1].taken.max() <= 9
    want = targets({"a": 1500, "b": 900, "c": 30})
    for i, s in ((1, "a"), (2, "b"), (3, "c")):
        assert abs(out[out.doc_id == i].taken.sum() - want[s]) <= 0.5 + 1e-6


def test_op5_awkward_rows(spark, awkward, nothing):
    out = mixing.mix_documents(awkward).collect()
    assert len(out) == awkward.count()
    assert all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert mixing.mix_documents(nothing).count() == 0
    assert mixing.mix_documents(nothing.unionByName(spark.createDataFrame([(1, None, None, None, None)], nothing.schema))).first()["taken"] == 0


def test_schedule_is_spread_and_ranked(spark):
    sources = spark.createDataFrame([(0, 50.0), (1, 30.0), (2, 20.0), (3, 0.0)], "number int, target double")
    rows = sorted((r["slot"], r["number"], r["rank"]) for r in mixing.schedule(spark, sources, 1000).collect())
    assert [r[0] for r in rows] == list(range(1000))
    seen = Counter()
    for i, number, rank in rows:
        assert rank == seen[number]
        seen[number] += 1
        for k, share in ((0, 0.5), (1, 0.3), (2, 0.2)):
            assert abs(seen[k] - share * (i + 1)) < 6
    x = spark.range(5).select(mixing.golden_point(F.col("id") + (1 << 35)).alias("x")).collect()
    exact = [((1 << 35) + i) * ((5**0.5 - 1) / 2) for i in range(5)]
    assert all(abs(r["x"] - e % 1) < 1e-4 for r, e in zip(x, exact, strict=True))


def test_mixed_copies(spark, awkward):
    out = mixing.mixed_copies(awkward)
    assert out.columns == awkward.columns
    assert max(Counter(r["doc_id"] for r in out.select("doc_id").collect()).values()) <= 6  # doc 2 is two rows


def feasible(sizes, shards, limit) -> bool:
    n, filled = 1, 0
    for g in sizes:
        if g > limit:
            return False
        if filled + g > limit:
            n, filled = n + 1, 0
        filled += g
    return n <= shards


def items_of(sizes):
    """Single groups as items."""
    return F.transform(sizes, lambda x: F.struct(x.alias("size"), F.lit(1).cast("long").alias("groups"), x.alias("most")))


@pytest.mark.parametrize("sizes", [[], [5], [1] * 20, [9, 1, 1, 1, 1, 1, 1, 1, 1, 9], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9], [100, 1, 1, 1], [1, 1, 1, 100], [50, 50, 50]])
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_capacity_and_cuts(spark, sizes, shards):
    frame = spark.createDataFrame([(sizes,)], "s array<bigint>").withColumn("c", sharding.capacity(items_of(F.col("s")), shards))
    row = frame.withColumn("cuts", sharding.cuts(F.col("s"), F.col("c"), shards)).first()
    limit = row["c"]
    assert feasible(sizes, shards, limit) and (not sizes or not feasible(sizes, shards, limit - 1))
    edges = [0, *row["cuts"], len(sizes)]
    assert len(row["cuts"]) < shards and edges == sorted(edges)
    assert all(sum(sizes[a:b]) <= limit for a, b in zip(edges, edges[1:], strict=False))


def test_capacity_on_many_lists(spark):
    @settings(max_examples=25, deadline=None)
    @given(st.lists(st.lists(st.integers(1, 60), max_size=25), min_size=1, max_size=20), st.integers(1, 8))
    def run(lists, shards):
        frame = spark.createDataFrame([(x,) for x in lists], "s array<bigint>").withColumn("c", sharding.capacity(items_of(F.col("s")), shards))
        for r in frame.withColumn("cuts", sharding.cuts(F.col("s"), F.col("c"), shards)).collect():
            assert feasible(r["s"], shards, r["c"]) and (not r["s"] or not feasible(r["s"], shards, r["c"] - 1))
            edges = [0, *r["cuts"], len(r["s"])]
            assert len(edges) <= shards + 1 and all(sum(r["s"][a:b]) <= r["c"] for a, b in zip(edges, edges[1:], strict=False))

    run()


@pytest.mark.parametrize("first_bits", [1, 4, 14])
def test_refined_capacity_is_that_of_the_groups(spark, first_bits):
    """Hashes that crowd under few prefixes, one large group among small ones: capacity and cuts equal brute force."""
    rng = np.random.default_rng(first_bits)
    crowd = [(1 << 60) + int(x) for x in rng.integers(0, 1 << 40, 60)] + [-(1 << 62) + int(x) for x in range(16)]
    spread = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 150)]
    for hashes, large in ((crowd, 0), (spread, 900), (crowd + spread, 4000), (list(range(16)), 0), ([5], 3), ([], 0)):
        groups = sorted({h: int(rng.integers(1, 60)) for h in hashes}.items())
        groups = [(h, b + large * (k == len(groups) // 2)) for k, (h, b) in enumerate(groups)]
        frame = spark.createDataFrame(groups, "h long, bytes long")
        limit, starts = sharding.group_cuts(frame, 8, first_bits)
        sizes = [b for _, b in groups]
        assert feasible(sizes, 8, limit) and (not sizes or not feasible(sizes, 8, limit - 1))
        filled = Counter()
        for h, b in groups:
            filled[sum(h >= s for s in starts)] += b
        assert len(starts) <= 7 and all(b <= limit for b in filled.values())


def test_equal_groups_of_one_prefix_are_dealt_evenly(spark):
    """Sixteen texts of equal size whose hashes share their leading bits fill all eight shards."""
    frame = spark.createDataFrame([((7 << 50) + k, 100) for k in range(16)], "h long, bytes long")
    limit, starts = sharding.group_cuts(frame, 8)
    assert limit == 200 and starts == [(7 << 50) + k for k in range(2, 16, 2)]


def check_shards(out, docs):
    assert len(out) == len(docs)
    assert sorted((r.doc_id, r.text_crc32, r.size) for r in out) == sorted((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for i, t in docs)
    slots, place = defaultdict(list), {}
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        assert place.setdefault(r.text_crc32, r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op9_on_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = sharding.shard_documents(docs).collect()
    check_shards(out, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.5 * np.mean(list(sizes.values()))


def test_op9_awkward_rows(spark, awkward, nothing):
    out = sharding.shard_documents(awkward.where("doc_id is not null")).collect()
    check_shards(out, [(r["doc_id"], r["text"]) for r in awkward.where("doc_id is not null").select("doc_id", "text").collect()])
    assert sharding.shard_documents(awkward).count() == awkward.count()
    assert sharding.shard_documents(nothing).count() == 0
    same = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"))
    assert len({r["shard"] for r in sharding.shard_documents(same).collect()}) == 1


def test_op4_learns_and_holds_out(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = quality.classify(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert list(out.held_out) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]
    assert (out.predicted == (out.score >= 0.3)).all()
    joined = out.merge(labels.toPandas(), on="doc_id")
    joined = joined[joined.held_out]
    assert (joined.predicted == joined.quality).mean() > 0.9
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    again = quality.classify(docs, flipped).toPandas()
    assert dict(zip(again.doc_id, again.score.round(9), strict=True)) == dict(zip(out.doc_id, out.score.round(9), strict=True))


def test_pairwise_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    width = quality.WORDS + quality.STATS
    model = quality.FactorisationMachine(rng.normal(size=width) * 0.1, rng.normal(size=(width, 4)) * 0.1)
    at, x = quality.features(b"Some words, some more words | and marks!!", 40, {})
    z = float(model.weights[at] @ x) + sum(float(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j]) for i in range(len(at)) for j in range(i))
    assert model.score(at, x) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_op4_awkward_rows(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (7, None), (None, 1)], "doc_id long, quality int")
    for given_labels in (none, labels):
        out = quality.classify(awkward, given_labels).collect()
        assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
        assert all(r["held_out"] for r in out if r["doc_id"] is None)
    assert quality.classify(nothing, labels).count() == 0
    assert quality.keep_good(awkward, none).columns == awkward.columns
