from __future__ import annotations

import compare
import pytest

from tidewright.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    compare.same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], sf_dir)


def test_greedy_keep_matches_a_loop(spark, sf_dir):
    from tidewright.plans import text

    members, pairs = text._near(spark, sf_dir)
    near = {}
    for r in pairs.collect():
        near.setdefault(r["right"], set()).add(r["left"])
    kept = set()
    for i in sorted(r["doc_id"] for r in members.where("doc_id = class").collect()):
        if not near.get(i, set()) & kept:
            kept.add(i)
    assert {r["doc_id"] for r in catalogue.queries()["greedy_keep"](spark, sf_dir).collect()} == kept


def test_split_balance_keeps_components_whole(spark, sf_dir):
    from tidewright.operators import graph
    from tidewright.plans import grading

    nodes, edges = grading._graph(spark, sf_dir)
    out = graph.assign_splits(graph.components(nodes, edges)).toPandas()
    assert (out.groupby("root").split.nunique() == 1).all()
    assert len(out) == nodes.count()


def test_perturbed_worlds_obey_the_rules(spark, sf_dir):
    out = catalogue.queries()["perturb_worlds"](spark, sf_dir).toPandas()
    assert out.groupby("seed").size().between(1, 3).all()
    assert (out.old != out.new).all()
    assert not out.column.str.endswith("_id").any()
    assert (out[out.column == "size"].new.astype(int) >= 0).all()
    assert set(out.seed) == set(range(1, 21))


def test_curriculum_matches_a_fold(spark, sf_dir):
    from tidewright.streaming.curriculum import advance, promote

    data = [(t, a, ((t * 7 + a * 3) % 5) / 4) for t in range(20) for a in range(12)]
    frame = spark.createDataFrame(data, "task_id long, arrival long, rate double")
    got = {r["task_id"]: r["level"] for r in promote(frame, levels=3, threshold=0.5).collect()}
    for t in range(20):
        level, rates = 0, []
        for a in range(12):
            level, rates = advance(level, rates, ((t * 7 + a * 3) % 5) / 4, 3, 0.5)
        assert got[t] == level
