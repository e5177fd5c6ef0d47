"""SimHash near-duplicates, components and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import cws, simhash
from tidewright.llm.components import components

LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps: list[int], bits: int = 2) -> list[int]:
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_op2_on_real_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    out = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).toPandas().set_index("doc_id")
    rows["fp"] = [fingerprint(t) for t in rows.text]
    assert [out.fingerprint[i] for i in rows.doc_id] == [f"{x:016x}" for x in rows.fp]
    rows["c"] = classes(list(rows.fp))
    least = rows.groupby("c").doc_id.transform("min")
    assert [out.component_id[i] for i in rows.doc_id] == list(least)


def test_links_connect_all_within_two_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for b in base for _ in range(8)] + [0, 1, 3, 7, (1 << 64) - 1, (1 << 63)]
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    want = classes([f & ((1 << 64) - 1) for f in signed])
    got = [roots.get(f, f) for f in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_crowded_values_lose_no_link(spark, crowd):
    """Many fingerprints around one centre, all pairs compared; a table value fetches no more than the crowd."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 5))}) for _ in range(300)}
    fps |= {(centre & ~0xFFFFFFFF) | rng.getrandbits(32) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(frame, crowd)).collect()}
    want, got = classes([f & ((1 << 64) - 1) for f in signed]), [roots.get(f, f) for f in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_probes_meet_within_one_bit_of_a_segment(spark):
    """The tables hold two rows a fingerprint; a probe and a table row meet for all pairs with a segment within one bit."""
    rng = random.Random(6)
    a = rng.getrandbits(63)
    cases = {a: 0, a ^ 1: 1, a ^ (1 << 40): 1, a ^ 3: 2, a ^ (1 << 40) ^ 1: 2, a ^ 7: 3, a ^ (7 << 33): 3, a ^ 3 ^ (3 << 40): 4}
    frame = spark.createDataFrame([(f,) for f in cases], "fp long")
    assert simhash.table(frame).count() == 2 * len(cases)
    met = simhash.probes(frame).alias("p").join(simhash.table(frame).alias("t"), ["segment", "value"]).select(F.least("p.fp", "t.fp").alias("x"), F.greatest("p.fp", "t.fp").alias("y")).distinct().collect()
    near = lambda x, y: any(((x >> s & 0xFFFFFFFF) ^ (y >> s & 0xFFFFFFFF)).bit_count() <= 1 for s in (0, 32))
    assert {(r["x"], r["y"]) for r in met} == {(min(x, y), max(x, y)) for x in cases for y in cases if near(x, y)}


def test_op2_awkward_rows(spark, awkward, nothing):
    out = simhash.near_duplicates(awkward).collect()
    assert len(out) == awkward.count()
    zero = {r["doc_id"]: r["component_id"] for r in out if r["fingerprint"] == "0" * 16}
    assert zero == {3: 3, 4: 3, 6: 3}
    assert {r["component_id"] for r in out if r["doc_id"] in (1, 2, 9)} == {1}
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_of_each_finds_edited_copies(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    texts, group = [], []
    for g in range(60):
        base = [word() for _ in range(rng.randint(80, 400))]
        for k in range(4):
            copy = list(base)
            for _ in range(k * len(base) // 200):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            group.append(g)
    kept = [r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert {group[i] for i in kept} == set(range(60))
    alike = [i for i in range(len(texts)) if i % 4 and len(grams(texts[i]) & grams(texts[i - i % 4])) / len(grams(texts[i]) | grams(texts[i - i % 4])) >= 0.8]
    assert len(set(alike) & set(kept)) <= 0.1 * len(alike)


def test_one_of_each_keeps_columns_and_classes(spark, awkward, nothing):
    out = simhash.one_of_each(awkward)
    assert out.columns == awkward.columns
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect() if r["doc_id"] is not None) == [1, 3, 5, 7, 8]
    assert out.where("doc_id is null").count() == 1
    assert simhash.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(1, 2), (2, 1), (3, 4)]])
def test_components(spark, edges):
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    group = {}
    for r in out:
        group.setdefault(r["root"], set()).add(r["node"])
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set().union(*group.values(), set()) == nodes
    assert len(group) == {0: 0, 1: 0, 200: 1, 299: 1, 3: 2}[len(edges)]


def terms(text: str) -> Counter:
    words = re.split(r"[\x20\x09-\x0D]+", text.lower())
    return Counter(zip(words, [*words[1:], None], strict=True))


def jaccard(a: str, b: str) -> float:
    x, y = terms(a), terms(b)
    return sum((x & y).values()) / sum((x | y).values())


def test_op3_on_real_documents(spark, sf_dir):
    out = cws.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("near", cws.likeness(F.col("signature"), F.col("edited_signature"))).toPandas().sort_values("doc_id")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    texts = list(rows.text)
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    assert list(out.edited_sha256) == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert list(out.n_chars) == [len(t) for t in texts]
    true = [jaccard(t, e) for t, e in zip(texts, edited, strict=True)]
    assert abs(sum(true) / len(true) - out.near.mean()) < 0.03
    error = (sum((t - n) ** 2 for t, n in zip(true, out.near, strict=True)) / len(true)) ** 0.5
    print("error of a document", error)
    assert error < 1.2 * (0.25 / cws.SAMPLES) ** 0.5
    by_text = {}
    for t, s in zip(texts, out.signature, strict=True):
        assert by_text.setdefault(t, list(s)) == list(s)


def test_op3_small_ranges_give_the_same(spark, awkward):
    docs = spark.createDataFrame([(i * i % 101, f"text number {i} " * (i % 5)) for i in range(60)], "doc_id long, text string")
    key = lambda d: sorted((r["id"], r["text"], r["next_text"]) for r in d.where("main").select("id", "text", "next_text").collect())
    whole, parted = key(cws.with_next(docs)), key(cws.with_next(docs, rows_per_range=4))
    assert whole == parted and len(whole) == 60


def test_op3_weights_count(spark):
    """Repeats change weights: the collision rate follows the generalised Jaccard similarity."""
    pairs = [("a b c d e f", "a b c d e f"), ("a b a b a b a b c d", "a b c d"), ("x y z", "p q r")]
    for a, b in pairs:
        seeds = [(f" {i} ".join(a.split()), f" {i} ".join(b.split())) for i in range(60)]
        frame = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(seeds)], "k int, s string, t string")
        left = cws.signatures(frame.select("k", "s"), ["k"], "s").withColumnRenamed("signature", "l")
        both = left.join(cws.signatures(frame.select("k", "t"), ["k"], "t"), "k").agg(F.avg(cws.likeness(F.col("l"), F.col("signature")))).first()[0]
        assert both == pytest.approx(sum(jaccard(s, t) for s, t in seeds) / len(seeds), abs=0.05)


def test_op3_awkward_rows(spark, awkward, nothing):
    out = cws.fingerprints(awkward).collect()
    assert len(out) == awkward.count() and all(len(r["signature"]) == len(r["edited_signature"]) == cws.SAMPLES for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[3]["signature"] == by[4]["signature"] and by[4]["n_chars"] == 0
    assert cws.fingerprints(nothing).count() == 0
    alone = cws.fingerprints(spark.createDataFrame([(1, "alone at last")], "doc_id long, text string")).first()
    assert alone["next_signature"] == alone["signature"]


def shingle_sets(texts: list[str]) -> list[set]:
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]


def likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def edited_copies() -> list[tuple[str, str]]:
    """(kind, text): texts, each followed by its copy with a passage appended, cut or replaced, or with words edited."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    out = []
    for k in range(240):
        base = [word() for _ in range(rng.randint(120, 600))]
        n, kind = rng.randint(1, max(1, len(base) // 6)), ("appended", "truncated", "replaced", "words")[k % 4]
        copy = {"appended": base + [word() for _ in range(n)], "truncated": base[:-n], "replaced": base[:-n] + [word() for _ in range(n)]}.get(kind, list(base))
        for _ in range(n // 5 if kind == "words" else 0):
            copy[rng.randrange(len(copy))] = word()
        out += [(kind, " ".join(base)), (kind, " ".join(copy))]
    return out


def test_one_of_each_finds_all_kinds_of_copies(spark):
    """Appended, truncated, block-replaced and word-edited copies of similarity 0.8 or more, against brute force."""
    cases = edited_copies()
    sets = shingle_sets([t for _, t in cases])
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    for kind in ("appended", "truncated", "replaced", "words"):
        alike = [i for i in range(1, len(cases), 2) if cases[i][0] == kind and likeness(sets[i - 1], sets[i]) >= 0.8]
        found = [i for i in alike if i not in kept]
        print(kind, len(found), len(alike))
        assert len(alike) >= 20 and found == alike


def test_one_of_each_equals_all_pairs(spark):
    """Chains of edits and a line that all share: the rows that stay are those of all pairs."""
    rng = random.Random(22)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") * rng.randint(1, 3)
    line, texts = " ".join(word() for _ in range(30)), ["", " \n", "one", "One"]
    for _ in range(12):
        copy = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(12):
            copy = [word() if rng.random() < 0.012 else w for w in copy]
            texts.append(" ".join(copy) + " " + line)
    sets = shingle_sets([t.lower() for t in texts])
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and likeness(sets[i], sets[j]) >= 0.8:
                least, other = sorted((root[i], root[j]))
                root = [least if r == other else r for r in root]
    kept = [r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted(set(root))


def test_one_of_each_keeps_what_is_less_alike(spark):
    """Pairs of similarity below 0.8, and texts that share no more than a much repeated line, all stay."""
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    texts = []
    for k in range(80):
        base = [word() for _ in range(rng.randint(150, 400))]
        copy = list(base)
        while likeness(*shingle_sets([" ".join(base), " ".join(copy)])) >= 0.8 - 0.001 * (k % 80):
            copy[rng.randrange(len(copy))] = word()
        texts += [" ".join(base), " ".join(copy)]
    line = " ".join(word() for _ in range(8))
    texts += [" ".join([line] * 60 + [word() for _ in range(30)]) for _ in range(20)]
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()
    print("kept", kept, "of", len(texts))
    assert kept == len(texts)


def test_one_of_each_takes_simhash_links(spark, monkeypatch):
    """The stage's copies are first those of multi-index hashing: its pairs are found by fingerprint, whatever shingles they share."""
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(400))
    texts = [text, text + " end", text.replace("w5 ", "v5 "), " ".join(f"x{i}" for i in range(300)), " ".join(f"y{i}" for i in range(300))]
    called = []
    pairs = simhash.simhash_pairs
    monkeypatch.setattr(simhash, "simhash_pairs", lambda nodes: called.append(pairs(nodes).collect()) or pairs(nodes))
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert kept == [0, 3, 4] and len(called) == 1 and called[0]
    frame = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 7 << 20), (5, 5)], "node long, fp long")
    assert {(r["a"], r["b"]) for r in pairs(frame).collect()} == {(1, 2), (1, 5), (1, 3)}


def test_rest_of_a_family_is_told_apart_by_sketches(spark):
    """Texts of 600 words that share half, less than a copy: their sketches alone rule out nearly all of the pairs."""
    import random
    from itertools import combinations

    rng = random.Random(2)
    passage = [f"p{i}" for i in range(300)]
    texts = [" ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(300)]) for _ in range(12)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select(simhash.shingle_shape(F.col("text"), 5, 0.8, []).alias("s")).select("s.*")
    rows = frame.collect()
    assert len({r["fp"] for r in rows}) > 1
    near = [1 for x, y in combinations(rows, 2) if sum((a ^ b).bit_count() if a >= 0 and b >= 0 else ((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x["sketch"], y["sketch"], strict=True)) <= (x["n"] + y["n"]) / 9]
    assert not near


def test_written_tables_leave_no_shuffle_files(spark):
    """The shuffle files of one table are gone before the next is made; only the write itself is set so."""
    from tidewright.sources import shared

    folders = [Path(str(f)) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    held = lambda: {p for f in folders for p in f.rglob("shuffle_*.data")}
    before, setting = held(), spark.conf.get(shared.CLEANUP)
    frame = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").alias("s"))
    assert frame.count() == 997 and held() > before
    before |= held()
    table = shared.written(frame)
    for _ in range(50):
        if not (left := held() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(shared.CLEANUP) == setting
    assert table.agg(F.sum("s")).first()[0] == 10_000 * 9_999 // 2 and shared.written(frame).count() == 997


def test_one_of_each_shuffles_whole_documents_once(spark):
    """What keeps and what drops repeated rows deals by one key; rows with null ids and null texts are found by it too."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "u v w x y z"), (None, "k l m n o p"), (None, "k l m n o p"), (5, "k l m n o p"), (None, None), (6, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.one_of_each(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, kept.collect()), key=str) == [(1, "a b c d e f"), (3, "u v w x y z"), (None, "k l m n o p"), (None, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning") == 2  # documents, and places of those that stay
