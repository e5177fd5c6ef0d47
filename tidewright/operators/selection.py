"""Quotas, caps, splits, schedules and replay draws, in deterministic hash orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.ordering import hash_order, hash_uniform
from tidewright.operators.ordered import places, running
from tidewright.sources.shared import written


def first_per(rows: DataFrame, keys: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__p", place).where(F.col("__p") <= n).drop("__p")


def per_task_cap(episodes: DataFrame, task: str, world: str, preference: list[Column | str], cap: int) -> DataFrame:
    """Up to ``cap`` episodes of each task: one of each world first, then the rest, each in the order of preference."""
    again = F.row_number().over(Window.partitionBy(task, world).orderBy(*preference)) > 1
    return first_per(episodes.withColumn("__w", again), [task], ["__w", *preference], cap).drop("__w")


def numbered(rows: DataFrame, order: Column, more: list[Column | str] = (), name: str = "place") -> DataFrame:
    """Adds the place, from 0, of each row in a hash order (hex text; ``more`` breaks ties).

    Rows are counted by the order's first four hex digits and numbered inside these cells, so that no task numbers all.
    """
    tagged = rows.withColumn("__o", order).withColumn("__cell", F.substring("__o", 1, 4))
    before = F.sum("__c").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = tagged.groupBy("__cell").agg(F.count("*").alias("__c")).select("__cell", F.coalesce(before, F.lit(0)).alias("__b"))
    place = F.row_number().over(Window.partitionBy("__cell").orderBy("__o", *more)) + F.col("__b") - 1
    return tagged.join(cells, "__cell").withColumn(name, place).drop("__o", "__cell", "__b")


def top_by_order(rows: DataFrame, order: list[Column | str], room: DataFrame) -> DataFrame:
    """The first rows of a total order, as many as the single value of ``room`` (column n) says.

    The order is a hash, as ``numbered`` wants it.
    """
    first = order[0] if isinstance(order[0], Column) else F.col(order[0])
    limit = room.first()[0]
    return numbered(rows, first, order[1:], "__p").where(F.col("__p") < int(limit or 0)).drop("__p")


def share_quota(rows: DataFrame, limited: Column, share: float, order: list[Column | str]) -> DataFrame:
    """All rows that are not limited, and of the limited ones the first floor(share / (1 - share) * others)."""
    others, few = rows.where(~limited), rows.where(limited)
    room = others.agg(F.floor(F.lit(share / max(1e-9, 1 - share)) * F.count("*")).alias("n"))
    return others.unionByName(top_by_order(few, order, room))


def language_quota(rows: DataFrame, main: Column, share: float, order: list[Column | str]) -> DataFrame:
    """Where the main language is under ``share``, the others are cut to floor(main * (1 - share) / share)."""
    counts = rows.agg(F.count(F.when(main, 1)).alias("m"), F.count("*").alias("n"))
    cut = (F.col("m") > 0) & (F.col("m") / F.col("n") < share)
    room = counts.select(F.when(cut, F.floor(F.col("m") * F.lit(1 - share) / F.lit(share))).otherwise(F.col("n")).alias("n"))
    return rows.where(main).unionByName(top_by_order(rows.where(~main), order, room))


def domain_cap(rows: DataFrame, domain: str, share: float, order: list[Column | str]) -> DataFrame:
    """The first max(1, floor(share * rows)) of each domain; the cap counts the rows before capping."""
    cap = max(1, int(share * rows.count()))
    return first_per(rows, [domain], order, cap)


def domain_holdout(rows: DataFrame, domain: str, share: float) -> DataFrame:
    """domain, n and held: whole domains in hash order until the held rows reach ``share`` of all; one row per domain."""
    sizes = rows.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("n"))
    placed = running(sizes.withColumn("__o", F.sha2(F.col("domain").cast("string"), 256)), ["__o", "domain"], {"__before": ("sum", F.col("n"))})
    all_rows = rows.agg(F.count("*").alias("__all"))  # one row
    return placed.join(F.broadcast(all_rows)).select("domain", "n", (F.coalesce("__before", F.lit(0)) < F.col("__all") * F.lit(share)).alias("held"))


def assign_eval(rows: DataFrame, family: str, share: float) -> DataFrame:
    """family, n and split: whole families by falling name go to eval until its size reaches ``share``; one stays in train."""
    sizes = rows.groupBy(F.col(family).alias("family")).agg(F.count("*").alias("n"))
    placed = running(sizes, [F.desc("family")], {"__before": ("sum", F.col("n")), "__place": ("sum", F.lit(1))})
    whole = sizes.agg(F.sum("n").alias("__all"), F.count("*").alias("__families"))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    held = (zero("__before") < F.col("__all") * F.lit(share)) & (zero("__place") + 1 < F.col("__families"))
    return placed.join(F.broadcast(whole)).select("family", "n", F.when(held, "eval").otherwise("train").alias("split"))


def epoch_schedule(tasks: DataFrame, key: str, *, epochs: int, batch: int, seed: int = 0) -> DataFrame:
    """epoch, place, batch, dataset_index and job_seed of each task: a hash order per epoch, so more epochs keep the prefix."""
    n = tasks.count()
    spread = tasks.select(key).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    ordered = spread.withColumn("__o", hash_order(seed, "schedule", "epoch", key)).withColumn("__cell", F.substring("__o", 1, 3))
    cells = ordered.groupBy("epoch", "__cell").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("epoch").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("epoch", "__cell", F.coalesce(before, F.lit(0)).alias("__b"))
    place = F.row_number().over(Window.partitionBy("epoch", "__cell").orderBy("__o", key)) + F.col("__b") - 1
    placed = ordered.join(cells, ["epoch", "__cell"]).withColumn("place", place.cast("long"))
    index = F.col("epoch") * n + F.col("place")
    batches = -(-n // batch)
    return placed.select(
        key, "epoch", "place", (F.col("epoch") * batches + F.floor(F.col("place") / batch)).alias("batch"), index.cast("long").alias("dataset_index"), (index + seed).cast("long").alias("job_seed")
    )


def prefetch_limit(schedule: DataFrame, next_batch: int) -> DataFrame:
    """The first dataset index past the batch after ``next_batch``, or past the last batch."""
    last = schedule.agg(F.max("batch").alias("last"))
    return schedule.join(F.broadcast(last)).where(F.col("batch") == F.least(F.lit(next_batch + 1), F.col("last"))).agg((F.max("dataset_index") + 1).alias("limit"))


def eligible_replay(entries: DataFrame, current_version: int, *, max_uses: int, max_age: int) -> DataFrame:
    age = F.lit(current_version) - F.col("age_origin")
    return entries.where((F.col("uses") < max_uses) & age.between(0, max_age))


def weighted_replay(entries: DataFrame, weights: DataFrame, *, draws: int, seed: int = 0) -> DataFrame:
    """draw, task_id and entry_id: a task by weight, then one of its entries uniformly.

    ``weights`` (task_id, weight) is one row per task; a draw's point is matched to the cumulative weights of the tasks
    that have entries, in a single window over one row a task.
    """
    per_task = entries.groupBy("task_id").agg(F.count("*").alias("__n"))
    order = Window.orderBy("task_id")
    held = weights.where("weight > 0").join(per_task, "task_id").withColumn("__to", F.sum("weight").over(order) / F.sum("weight").over(Window.partitionBy()))
    held = held.select("task_id", "__n", F.coalesce(F.lag("__to").over(order), F.lit(0.0)).alias("__from"), F.when(F.lead("__to").over(order).isNull(), 2.0).otherwise(F.col("__to")).alias("__to"))
    cells = 256
    held = held.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__from") * cells), F.floor(F.least("__to", F.lit(0.999999999)) * cells))))
    points = entries.sparkSession.range(draws).select(F.col("id").alias("draw"), hash_uniform(seed, "task", "id").alias("__u"), hash_uniform(seed, "entry", "id").alias("__e"))
    chosen = points.withColumn("__cell", F.floor(F.col("__u") * cells)).join(held, "__cell").where("__u >= __from and __u < __to")
    numbered = entries.select("task_id", "entry_id", (F.row_number().over(Window.partitionBy("task_id").orderBy("entry_id")) - 1).cast("long").alias("__i"))
    return chosen.withColumn("__i", F.floor(F.col("__e") * F.col("__n"))).join(numbered, ["task_id", "__i"]).select("draw", "task_id", "entry_id")


def minibatches(samples: DataFrame, group: str, size: int, *, seed: int = 0) -> DataFrame:
    """Adds ``minibatch``: whole groups in hash order, ``size`` groups in each."""
    groups = numbered(samples.select(group).distinct(), hash_order(seed, "minibatch", group), [group], "__p")
    return samples.join(groups.select(group, F.floor(F.col("__p") / size).alias("minibatch")), group)


def contiguous_prefix(acks: DataFrame, worker: str, index: str) -> DataFrame:
    """worker and position: how far each worker's acknowledged indices run from 0 without a gap (duplicates count once)."""
    order = Window.partitionBy(worker).orderBy(index)
    seen = acks.select(worker, index).distinct().withColumn("__gap", F.col(index) - F.row_number().over(order) + 1)
    return seen.groupBy(worker).agg(F.count(F.when(F.col("__gap") == 0, 1)).alias("position"))


def prune_checkpoints(checkpoints: DataFrame, keep: int) -> DataFrame:
    """Adds ``kept`` to (version, is_pointer): the pointer, and the newest up to ``keep`` in all (a single window over the checkpoints)."""
    order = Window.orderBy(F.desc(F.coalesce("is_pointer", F.lit(False))), F.desc("version"))
    return checkpoints.withColumn("kept", F.row_number().over(order) <= max(1, keep))


def prune_snapshots(snapshots: DataFrame, current: int, keep: int, protected: list[int] = ()) -> DataFrame:
    """Versions that can go: below current - keep + 1, never 0 and never protected."""
    return snapshots.where((F.col("version") < current - keep + 1) & (F.col("version") != 0) & ~F.col("version").isin(list(protected) or [-1]))


def _filled(lengths, open_rows: list[int], max_sequences: int, max_tokens: int):
    """For each number of rows in the open batch before these rows: rows in the open batch after them, batches begun, and both after each row."""
    import numpy as np

    held, begun, after = np.array(open_rows), np.zeros(len(open_rows), np.int64), []
    for length in lengths:
        fresh = (held == 0) | (held + 1 > max_sequences) | (length * (held + 1) > max_tokens)
        held, begun = np.where(fresh, 1, held + 1), begun + fresh
        after.append(begun)
    return held, begun, after


def fits(lengths: DataFrame, max_sequences: int, max_tokens: int, bucket: str = "bucket", cell: int = 4096) -> DataFrame:
    """Physical batches: per bucket, by rising length, rows fill a batch until either budget would be passed.

    A batch's padded size is its longest row times its rows, and a row of its own may pass the budget. Only the number of rows in
    the open batch, ``max_sequences`` at most, carries over from row to row. So each cell of consecutive rows tells, for every such
    number before it, the number after it and the batches begun; these maps are joined to maps over twice as many cells until
    they span the bucket, and each cell then gets its start by steps of falling length. A bucket of any size is spread over tasks.
    Returns bucket, sample_id and batch.
    """
    import pandas as pd

    starts = list(range(max_sequences + 1))
    placed = places(lengths.select(bucket, "sample_id", "length"), ["length", "sample_id"], [bucket])
    placed = written(placed.withColumn("cell", F.floor(F.col("place") / cell)))

    def summed(key, frame):
        held, begun, _ = _filled(frame.sort_values("place")["length"], starts, max_sequences, max_tokens)
        return pd.DataFrame({bucket: key[0], "cell": key[1], "held": starts, "to": held, "begun": begun})

    maps = written(placed.groupBy(bucket, "cell").applyInPandas(summed, f"{bucket} long, cell long, held int, to int, begun long"))
    last = placed.agg(F.max("cell")).first()[0] or 0
    steps, span = [maps], 1
    while 2 * span <= last:
        then = steps[-1].select(bucket, (F.col("cell") - span).alias("cell"), F.col("held").alias("to"), F.col("to").alias("__to"), F.col("begun").alias("__begun"))
        steps.append(written(steps[-1].join(then, [bucket, "cell", "to"]).select(bucket, "cell", "held", F.col("__to").alias("to"), (F.col("begun") + F.col("__begun")).alias("begun"))))
        span *= 2
    at = placed.where("place = 0").select(bucket, F.lit(0).cast("long").alias("cell"), F.lit(0).alias("held"), F.lit(0).cast("long").alias("before"))
    for step in reversed(steps):
        ahead = at.join(step, [bucket, "cell", "held"]).select(bucket, (F.col("cell") + span).alias("cell"), F.col("to").alias("held"), (F.col("before") + F.col("begun")).alias("before"))
        at = written(at.unionByName(ahead.join(maps.where("held = 0").select(bucket, "cell"), [bucket, "cell"], "left_semi")))
        span //= 2

    def pack(key, rows, start):
        rows = rows.sort_values("place")
        _, _, after = _filled(rows["length"], start["held"].tolist(), max_sequences, max_tokens)
        return pd.DataFrame({bucket: rows[bucket], "sample_id": rows["sample_id"], "batch": [int(start["before"].iloc[0]) + int(a[0]) - 1 for a in after]})

    cells = at.withColumnsRenamed({bucket: "__b", "cell": "__c"})
    return placed.groupBy(bucket, "cell").cogroup(cells.groupBy("__b", "__c")).applyInPandas(pack, f"{bucket} long, sample_id long, batch long")
