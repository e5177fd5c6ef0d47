"""Orders, components, splits, batches and resamples whose parts are worked on apart, against plain folds."""

from __future__ import annotations

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tidewright.operators import graph, ordered, selection, statistics


def test_running_values_equal_a_fold(spark):
    rng = random.Random(1)
    data = [(rng.choice("abc"), rng.randint(-50, 50), i, rng.randint(-9, 9)) for i in range(400)]
    frame = spark.createDataFrame(data, "key string, x int, id long, v int").repartition(5)
    out = ordered.running(frame, [F.desc("x"), "id"], {"total": ("sum", F.col("v")), "most": ("max", F.col("v"))}, ["key"]).collect()
    assert len(out) == len(data)
    for k in "abc":
        before: list[int] = []
        for r in sorted((r for r in out if r["key"] == k), key=lambda r: (-r["x"], r["id"])):
            assert (r["total"], r["most"]) == ((sum(before), max(before)) if before else (None, None))
            before.append(r["v"])
    assert [r["place"] for r in sorted(ordered.places(frame, ["x", "id"]).collect(), key=lambda r: (r["x"], r["id"]))] == list(range(400))


def test_a_chain_in_order_takes_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, real=graph.written: tables.append(1) or real(df))
    nodes = spark.range(4096)
    out = graph.components(nodes, spark.range(4095).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert out.groupBy("root").count().collect()[0]["count"] == 4096
    assert (len(tables) - 2) / 3 <= 30


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)]
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(300)], "id string")
    root = {f"n{i}": f"n{i}" for i in range(300)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = {r["id"]: r["root"] for r in graph.components(nodes, spark.createDataFrame(edges, "a string, b string")).collect()}
    assert out == {x: find(x) for x in root}


@pytest.mark.parametrize("assigned", [0, 25])
def test_splits_equal_a_fold(spark, assigned):
    rng = random.Random(7)
    sizes = [rng.choice([1, 1, 1, 1, 2, 2, 3, 5, 9]) for _ in range(90)]
    labels = [(f"r{k:03}-{i}", f"r{k:03}-0") for k, n in enumerate(sizes) for i in range(n)]
    known = {x: rng.choice(graph.SPLITS) for x, _ in rng.sample(labels, assigned)}
    frame = spark.createDataFrame(labels, "id string, root string")
    given = spark.createDataFrame([*known.items(), ("gone", "dev"), (labels[0][0], "no split")] if known else [], "id string, split string")
    out = {r["id"]: r["split"] for r in graph.assign_splits(frame, given).collect()}
    members: dict[str, list] = {}
    for x, r in labels:
        members.setdefault(r, []).append(x)
    split, load = dict(known), {s: list(known.values()).count(s) for s in graph.SPLITS}
    votes = {r: [known[x] for x in m if x in known] for r, m in members.items()}
    for r, m in sorted(members.items(), key=lambda x: (-len(x[1]), not votes[x[0]], x[0])):
        placed = votes[r]
        target = max(sorted(set(placed)), key=placed.count) if placed else min(graph.SPLITS, key=lambda s: (load[s], s))
        for x in m:
            if x not in split:
                split[x] = target
                load[target] += 1
    assert out == split


@pytest.mark.parametrize("cell", [7, 4096])
def test_physical_batches_equal_a_fold(spark, cell):
    rng = random.Random(3)
    rows = [(b, i, rng.choice([1, 5, 20, 60, 400])) for b, n in ((1, 90), (2, 3), (3, 41)) for i in range(n)]
    out = {(r["bucket"], r["sample_id"]): r["batch"] for r in selection.fits(spark.createDataFrame(rows, "bucket long, sample_id long, length long"), 6, 300, cell=cell).collect()}
    for b in (1, 2, 3):
        batch, held = -1, 0
        for _, i, n in sorted((x for x in rows if x[0] == b), key=lambda x: (x[2], x[1])):
            if not held or held + 1 > 6 or n * (held + 1) > 300:
                batch, held = batch + 1, 0
            held += 1
            assert out[b, i] == batch
    assert len(out) == len(rows)


def test_resamples_average_over_episodes(spark):
    rows = [(t, float(t % 3)) for t in range(60) for _ in range(1 + 20 * (t % 3 == 0))]
    means = statistics.bootstrap_means(spark.createDataFrame(rows, "task long, v double"), "task", "v", draws=400)
    values = sorted(r["mean"] for r in means.collect())
    assert len(values) == 400
    low, high = statistics.interval(means).first()
    assert (low, high) == (values[10], values[389])
    mean = sum(v for _, v in rows) / len(rows)
    assert low < mean < high and abs(sum(values) / 400 - mean) < 0.02
    assert all(a <= b for a, b in pairwise(values))


def test_similar_pairs_equal_a_loop(spark):
    """All pairs of sets of any sizes at several thresholds, ties in size and frequency included."""
    rng = random.Random(6)
    base = [rng.sample(range(60), rng.randint(1, 30)) for _ in range(12)]
    sets = [sorted({*(x for x in b if rng.random() > 0.1), *rng.sample(range(60), rng.randint(0, 2))} or {1}) for b in base for _ in range(6)]
    frame = spark.createDataFrame([(i, [f"g{x}" for x in s]) for i, s in enumerate(sets)], "id long, g array<string>")
    from tidewright.operators import text

    for threshold in (0.5, 0.8, 0.9):
        got = {(r["left"], r["right"]): r["similarity"] for r in text.similar_pairs(frame, "id", "g", threshold).collect()}
        want = {(i, j): len({*a} & {*b}) / len({*a} | {*b}) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j}
        assert got == pytest.approx({k: v for k, v in want.items() if v >= threshold}) and got


def test_similar_texts_equal_a_loop(spark, monkeypatch):
    """Pairs and classes by all pairs of sets, over several blocks of several sizes, with empty, short and equal texts and astral letters."""
    from tidewright.operators import text

    monkeypatch.setattr(text, "BLOCK_ROWS", (40, 50))
    rng = random.Random(8)
    letters = "abcdefghij𝔸é"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 30, 300, 1500]))) for _ in range(40)]
    texts = ["", "", "a", "ab", "ab", "ba"]
    for b in base:
        texts += [b, b[: int(len(b) * rng.uniform(0.88, 1))], b + "".join(rng.choice(letters) for _ in range(len(b) // 30)), b + b[:2], b]
    grams = [frozenset(t[i : i + 3] for i in range(len(t) - 2)) if len(t) > 2 else frozenset([t]) for t in texts]
    members, pairs = text.similar_texts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.9)
    first = {}
    for i, g in enumerate(grams):
        first.setdefault(g, i)
    assert {r["id"]: r["class"] for r in members.collect()} == {i: first[g] for i, g in enumerate(grams)}
    want = {(i, j): len(a & b) / len(a | b) for a, i in first.items() for b, j in first.items() if i < j}
    got = pairs.collect()
    assert len(got) > 20 and {(r["left"], r["right"]): r["similarity"] for r in got} == pytest.approx({k: v for k, v in want.items() if v >= 0.9})
    assert len({(r["left"], r["right"]) for r in got}) == len(got)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_only_texts_with_a_possible_partner_move(spark, monkeypatch, most):
    """Whole texts are chosen where they are read, up to a bound of rows; beyond it, and over many small cells, the pairs are the same."""
    from tidewright.operators import text

    monkeypatch.setattr(text, "BROADCAST_PLACES", most)
    monkeypatch.setattr(text, "CELL_CHARS", (300, 300))
    monkeypatch.setattr(text, "BLOCK_ROWS", (40, 50))
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = [own(rng.choice([40, 200, 900])) for _ in range(120)]
    texts += [t + t[:2] + own(1) for t in texts[:25]] + ["x" + t for t in texts[:25]]
    grams = [frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = text.similar_texts(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 0.9)[1]
        assert ("SortMergeJoin" in plan_of(pairs)) == (most == 0)
        got = {(r["left"], r["right"]): r["similarity"] for r in pairs.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    likeness = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in range(len(texts)) for j in range(i + 1, len(texts))}
    assert len(got) > 40 and got == pytest.approx({k: v for k, v in likeness.items() if v >= 0.9})


def test_blocks_that_a_text_meets_do_not_grow_with_the_table():
    from tidewright.operators import text

    def met(times: int) -> float:
        """Blocks that a row meets, on average, at so many times a table of 650 million characters."""
        sizes = [(n, 300 * times, 300 * 4 * n * times) for n in range(50, 1050)]
        places, pairs = text.size_blocks(sizes, 0.9)
        return sum(300 * times * sum(1 for b, *_ in pairs if b == first) for _, first, _ in places) / (300 * times * len(places))

    assert met(12) <= 1.2 * met(1)


@pytest.mark.parametrize("name", ["near_duplicates", "greedy_keep"])
def test_near_duplicates_keep_less_than_they_read(spark, name):
    """The tables that the join of whole texts leaves are far smaller than the texts: no grams are stored."""
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    kept = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    from tidewright.plans import catalogue

    before = kept()
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.01").count() > 800
    assert kept() - before < Path("/root/testdata/sf0.01/documents.parquet").stat().st_size / 2


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["cascades", "overlays", "state_diff", "terminal_rewards", "fork_points"])
def test_tasks_follow_the_number_of_rows(spark, sf_dir, monkeypatch, name):
    """Rows are dealt to as many tasks as their number needs, so what one task sorts or groups does not grow."""
    from tidewright.plans import catalogue
    from tidewright.sources import shared

    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    plan = plan_of(catalogue.queries()[name](spark, sf_dir))
    assert "REPARTITION_BY_NUM" in plan and (name == "overlays" or "Join" not in plan or name in ("terminal_rewards", "fork_points"))


def test_leaf_gaps_read_speech_once(spark, sf_dir):
    """Why a leaf was not matched is found once: the counts and the examples read it."""
    from tidewright.plans import catalogue

    assert "ArrowEvalPython" not in plan_of(catalogue.queries()["leaf_gaps"](spark, sf_dir))


def test_equal_values_have_equal_tags(spark):
    """Shares by the short cut are those of the tags, and texts are read once."""
    from tidewright.functions import answers

    values = [None, True, False, 1, 0, 1.0, "1", " 1", "$1", "a", "A", "2024-01-05", "2024-01-05T00:00", "", [], ["a"], {}, {"a": 1}]
    node = answers.Value({})
    for x in values:
        for y in values:
            assert node.share(x, y, answers.Known()) == float(answers.tagged({}, x) == answers.tagged({}, y)), (x, y)
    answers.text_tag.cache_clear()
    assert [answers.tagged(None, "some text") for _ in range(3)] == ["s:sometext"] * 3 and answers.text_tag.cache_info().hits == 2
