"""Scene graphs: components, balanced splits and seeded walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.ordering import hash_order
from tidewright.operators.ordered import places
from tidewright.sources.shared import written

SPLITS = ("dev", "holdout-1", "holdout-2", "holdout-3", "holdout-4", "holdout-5")


def linked(edges: DataFrame) -> DataFrame:
    """node and root of every node in the pairs (a, b); nodes with one root are exactly those connected.

    Randomised contraction: each round every node takes the node of least hash in its closed neighbourhood, under a hash of the
    round's own, then that node's choice, and the edges between chosen nodes remain. The expected number of rounds is
    logarithmic in the nodes whatever their order, tables only shrink, and minima are aggregated before any shuffle. The rounds'
    choices are joined once, from the last to the first. An empty table gives an empty result.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    kind, choices, turn = dict(edges.dtypes)["a"], [], 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda x: F.struct(F.xxhash64(F.lit(turn), x).alias("h"), x.alias("x"))  # noqa: E731, B023
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(order(F.col("b"))).alias("m"))
        near = written(near.select("node", F.least(F.col("m"), order(F.col("node")))["x"].alias("rep")))
        hop = near.select(F.col("node").alias("rep"), F.col("rep").alias("next"))
        chosen = written(near.join(hop, "rep").select("node", F.col("next").alias("rep")))
        choices.append(chosen)
        ends = edges.join(chosen.withColumnsRenamed({"node": "a", "rep": "x"}), "a").join(chosen.withColumnsRenamed({"node": "b", "rep": "y"}), "b")
        edges = written(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not choices:
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    roots = choices[-1].select("node", F.col("rep").alias("root"))
    for chosen in reversed(choices[:-1]):
        later = roots.select(F.col("node").alias("rep"), "root")
        roots = chosen.join(later, "rep", "left").select("node", F.coalesce("root", "rep").alias("root"))
    return roots


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and root (the least id of its component) of all nodes, by randomised contraction; self loops and edges with unknown ends are dropped."""
    ids = nodes.select("id").distinct()
    known = edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    found = written(linked(known))
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    labels = found.join(least, "root").select(F.col("node").alias("id"), F.col("least").alias("root"))
    return ids.join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def dealt_in_turn(size: int, count: int, loads: dict[str, int]) -> list[tuple[int, list[str]]]:
    """Where ``count`` components of one size go, each to the least loaded split (by load, then name), in closed form.

    Splits join from the least loaded on; between two joinings the components go round those that have joined. Returns for
    each such stretch the number of its first component and the round; ``loads`` is brought up to date.
    """
    ranked, out, at = sorted(loads, key=lambda s: (loads[s], s)), [], 0
    for k in range(1, len(ranked) + 1):
        turn = sorted(ranked[:k], key=lambda s: (loads[s], s))
        left = count - at
        if k < len(ranked):
            bar = ranked[k]
            left = min(left, sum(max(0, -(-(loads[bar] - loads[s] + (s < bar)) // size)) for s in turn))
        if not left:
            continue
        out.append((at, turn))
        for i, s in enumerate(turn):
            loads[s] += size * (left // k + (i < left % k))
        at += left
    return out


def assign_splits(labels: DataFrame, known: DataFrame | None = None, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """id, root and split: whole components; assigned nodes keep theirs.

    By falling size, components with assigned nodes go to the split most frequent among these (the least name on ties); then the
    others of that size, by root, each to the least loaded split (by load, then name). What is folded in order is one row for each
    size of components, at most the square root of twice the nodes; a component finds its split from its number within its size.
    """
    given = known if known is not None else labels.select("id", F.lit(None).cast("string").alias("split")).limit(0)
    rows = labels.join(given, "id", "left")
    fixed = F.array(*[F.lit(s) for s in sorted(splits)])
    votes = rows.where(F.col("split").isin(*splits)).groupBy("root", "split").count().groupBy("root").agg(
        F.max_by("split", F.struct("count", -F.array_position(fixed, F.col("split")))).alias("vote"), F.sum("count").alias("placed")
    )
    sizes = written(rows.groupBy("root").count().join(votes, "root", "left").select("root", F.col("count").alias("size"), (F.col("count") - F.coalesce("placed", F.lit(0))).alias("new"), "vote"))
    loads = dict.fromkeys(splits, 0) | {r["split"]: r["count"] for r in rows.where(F.col("split").isin(*splits)).groupBy("split").count().collect()}
    runs = sizes.groupBy("size").agg(F.count(F.when(F.col("vote").isNull(), 1)).alias("free"), *[F.sum(F.when(F.col("vote") == s, F.col("new")).otherwise(0)).alias(s) for s in splits])
    turns = []
    for run in runs.orderBy(F.desc("size")).toLocalIterator():  # a row for each size
        for s in splits:
            loads[s] += run[s]
        stretches = dealt_in_turn(run["size"], run["free"], loads)
        ends = [at for at, _ in stretches[1:]] + [run["free"]] * bool(stretches)
        turns += [(run["size"], at, end, turn) for (at, turn), end in zip(stretches, ends, strict=True)]
    turn = labels.sparkSession.createDataFrame(turns, "size long, first long, end long, turn array<string>")
    free = places(sizes.where("vote is null").select("root", "size"), ["root"], ["size"]).join(turn, "size").where("place >= first and place < end")
    chosen = free.select("root", F.get("turn", ((F.col("place") - F.col("first")) % F.size("turn")).cast("int")).alias("chosen"))
    chosen = chosen.unionByName(sizes.where("vote is not null").select("root", F.col("vote").alias("chosen")))
    return rows.join(chosen, "root").select("id", "root", F.coalesce(F.when(F.col("split").isin(*splits), F.col("split")), "chosen").alias("split"))


def walks(edges: DataFrame, starts: DataFrame, hops: int, seed: int = 0) -> DataFrame:
    """walk and path: from each start, ``hops`` steps to a neighbour not yet visited, chosen by hash; shorter if stuck."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().where("a <> b")
    state = starts.select("walk", F.array("id").alias("path"))
    for step in range(hops):
        nexts = state.withColumn("a", F.element_at("path", -1)).join(both, "a").where(~F.array_contains("path", F.col("b")))
        order = Window.partitionBy("walk").orderBy(hash_order(seed, f"walk{step}", "walk", "b"), "b")
        taken = nexts.withColumn("k", F.row_number().over(order)).where("k = 1").select("walk", "b")
        state = state.join(taken, "walk", "left").select("walk", F.when(F.col("b").isNotNull(), F.array_append("path", F.col("b"))).otherwise(F.col("path")).alias("path"))
    return state
