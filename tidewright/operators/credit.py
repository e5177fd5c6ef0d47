"""Group-normalised, tree and generalised advantages, task scales, samples and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.rl import gae


def kept(trainable: str | None) -> Column:
    """Whether an episode counts: true unless explicitly marked false."""
    return F.lit(True) if trainable is None else F.coalesce(F.col(trainable), F.lit(True))


def group_advantages(episodes: DataFrame, group: str, reward: str, *, trainable: str | None = None, scale: str | None = None, epsilon: float = 1e-8) -> DataFrame:
    """Adds ``advantage``: (reward - mean) / (spread + epsilon) over the kept episodes of a group.

    The spread is the population deviation, or the column ``scale`` where that is not null. Groups of fewer than two kept
    episodes and episodes that are not kept get 0. A group's statistics are aggregated before the join back, so a large
    group is never in one task.
    """
    ok = kept(trainable)
    value = F.when(ok, F.col(reward))
    stats = episodes.groupBy(group).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.count(value).alias("__n"))
    joined = episodes.join(stats, group)
    spread = F.col("__s") if scale is None else F.coalesce(F.col(scale), F.col("__s"))
    advantage = F.when(ok & (F.col("__n") >= 2), (F.col(reward) - F.col("__m")) / (spread + epsilon)).otherwise(0.0)
    return joined.withColumn("advantage", advantage).drop("__m", "__s", "__n")


def task_scale(episodes: DataFrame, task: str, group: str, arrival: list[str], reward: str, *, window: int = 64, minimum: int = 8, trainable: str | None = None) -> DataFrame:
    """task, group and ``scale``: the deviation of the task's last ``window`` kept rewards when the group has arrived.

    Groups arrive in the order of ``arrival`` (which must order a task's episodes, groups being contiguous); null below
    ``minimum`` rewards. Overlapping frames of fixed length need one pass per task.
    """
    rows = episodes.where(kept(trainable))
    order = Window.partitionBy(task).orderBy(*arrival)
    frame = order.rowsBetween(-(window - 1), 0)
    held = rows.select(
        task, group, F.row_number().over(order).alias("__i"), F.stddev_pop(reward).over(frame).alias("__s"), F.count(reward).over(frame).alias("__n")
    )
    last = F.max_by(F.struct("__s", "__n"), "__i")
    ended = held.groupBy(task, group).agg(last.alias("__l"))
    return ended.select(task, group, F.when(F.col("__l.__n") >= minimum, F.col("__l.__s")).alias("scale"))


def sample_weights(actions: DataFrame, group: str, episode: str, tokens: Column, *, trainable: str | None = None, aggregation: str = "sequence") -> DataFrame:
    """Adds ``weight`` to the actions of each group; the weights of a group's kept actions sum to 1.

    ``sequence``: every kept episode weighs the same and its tokens share it; ``token``: every kept token weighs the same.
    """
    ok = kept(trainable)
    rows = actions.withColumn("__t", tokens)
    episodes = rows.groupBy(group, episode).agg(F.sum("__t").alias("__e"), F.bool_and(ok).alias("__k"))
    groups = episodes.groupBy(group).agg(F.sum(F.when(F.col("__k"), F.col("__e")).otherwise(0)).alias("__g"), F.count(F.when(F.col("__k"), 1)).alias("__n"))
    joined = rows.join(episodes.join(groups, group), [group, episode])
    share = F.col("__t") / F.greatest(F.lit(1), F.col("__g")) if aggregation == "token" else F.col("__t") / F.nullif(F.col("__e") * F.greatest(F.lit(1), F.col("__n")), F.lit(0))
    return joined.withColumn("weight", F.when(F.col("__k"), F.coalesce(share, F.lit(0.0))).otherwise(0.0)).drop("__t", "__e", "__k", "__g", "__n")


def episode_gae(actions: DataFrame, episode: str, order: list[str], *, reward: Column, value: Column, terminated: Column, bootstrap: Column, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """One row per episode with arrays ``steps`` (structs of the order columns), ``advantages`` and ``returns``."""
    row = F.struct(*order, reward.cast("double").alias("r"), value.cast("double").alias("v"), terminated.alias("t"))
    held = actions.groupBy(episode).agg(F.array_sort(F.collect_list(row)).alias("x"), F.max(bootstrap).cast("double").alias("b"))
    part = lambda name: F.transform("x", lambda s: s[name])
    flat = lambda value: F.transform("x", lambda _: F.lit(float(value)))
    held = held.withColumn("advantages", gae(part("r"), part("v"), part("t"), F.col("b"), flat(gamma), flat(lam)))
    return held.select(
        episode,
        F.transform("x", lambda s: F.struct(*[s[c].alias(c) for c in order])).alias("steps"),
        "advantages",
        F.zip_with("advantages", part("v"), lambda a, v: a + v).alias("returns"),
    )


def tree_advantages(episodes: DataFrame, *, mode: str = "segment", scale: str | None = None) -> DataFrame:
    """Per-action credit of tree groups: one row per episode with the array ``advantages``.

    ``episodes`` has group_id, episode_id, role (trunk or branch), trunk (null for trunks), fork_step, reward, n_actions
    and trainable. ``segment``: a trunk is cut at its forks; an action gets local and global credit of its segment's
    values. ``tree_grpo``: each kept trajectory scores against its tree and against all; a trunk's action gets the mean
    of the trajectories through it. Everything is divided by the kept rewards' spread, or the column ``scale``; a spread
    under 1e-8 gives 0.
    """
    e = episodes.withColumn("__k", F.coalesce("trainable", F.lit(True))).withColumn("__tree", F.coalesce("trunk", "episode_id"))
    reward = F.when(F.col("__k"), F.col("reward"))
    trunk_reward = F.when(F.col("__k") & (F.col("role") == "trunk"), F.col("reward"))
    groups = e.groupBy("group_id").agg(
        F.stddev_pop(reward).alias("__own"), F.avg(reward).alias("__all"), F.coalesce(F.avg(trunk_reward), F.avg(reward)).alias("__root"), *([F.max(scale).alias("__given")] if scale else [])
    )
    spread = F.coalesce(F.col("__given"), F.col("__own")) if scale else F.col("__own")
    groups = groups.select("group_id", spread.alias("__s"), "__all", "__root")
    trunks = e.where("role = 'trunk'").select("group_id", F.col("episode_id").alias("__tree"), F.when(F.col("__k"), F.col("reward")).alias("__tr"))
    trees = e.groupBy("group_id", "__tree").agg(F.avg(reward).alias("__mean"))
    leaf = (F.col("reward") - F.col("__mean")) + (F.col("reward") - F.col("__all"))
    e = e.join(groups, "group_id").join(trees, ["group_id", "__tree"]).join(trunks, ["group_id", "__tree"], "left").withColumn("__leaf", F.when(F.col("__k"), leaf))
    branches = e.where("role = 'branch'").groupBy("group_id", "__tree", "fork_step").agg(
        F.sum(reward).alias("__b"), F.count(reward).alias("__n"), F.max("__tr").alias("__tr"), F.sum("__leaf").alias("__leaves")
    )
    value = (F.coalesce("__b", F.lit(0.0)) + F.coalesce("__tr", F.lit(0.0))) / F.nullif(F.col("__n") + F.col("__tr").isNotNull().cast("int"), F.lit(0))
    forks = branches.select("group_id", "__tree", "fork_step", value.alias("__v"), "__n", F.coalesce("__leaves", F.lit(0.0)).alias("__leaves"))
    per_tree = forks.groupBy("group_id", "__tree").agg(F.array_sort(F.collect_list(F.struct("fork_step", "__v", "__n", "__leaves"))).alias("__forks"))
    e = e.join(per_tree, ["group_id", "__tree"], "left").withColumn("__forks", F.coalesce("__forks", F.expr("cast(array() as array<struct<fork_step:int,__v:double,__n:bigint,__leaves:double>>)")))
    e = e.withColumn("__j", F.expr("if(n_actions > 0, sequence(0, cast(n_actions as int) - 1), cast(array() as array<int>))"))
    own = F.get(F.filter("__forks", lambda f: f["fork_step"] == F.col("fork_step")), 0)["__v"]

    def on_trunk(j: Column) -> Column:
        if mode == "tree_grpo":
            later = F.filter("__forks", lambda f: f["fork_step"] > j)
            total = F.aggregate(later, F.col("__leaf"), lambda s, f: s + f["__leaves"])
            return total / F.aggregate(later, F.lit(1).cast("long"), lambda s, f: s + f["__n"])
        before, after = F.filter("__forks", lambda f: f["fork_step"] <= j), F.filter("__forks", lambda f: f["fork_step"] > j)
        begin = F.coalesce(F.try_element_at(before, F.lit(-1))["__v"], F.col("__root"))
        end = F.coalesce(F.get(after, 0)["__v"], F.col("reward"))
        return (end - begin) + (end - F.col("__root"))

    on_branch = F.col("__leaf") if mode == "tree_grpo" else (F.col("reward") - own) + (F.col("reward") - F.col("__root"))
    credit = F.transform("__j", lambda j: F.when(F.col("role") == "trunk", on_trunk(j)).otherwise(on_branch) / F.col("__s"))
    zero = F.transform("__j", lambda _: F.lit(0.0))
    return e.select("group_id", "episode_id", F.when(F.col("__k") & (F.col("__s") >= 1e-8), credit).otherwise(zero).alias("advantages"))


def choose_forks(trunks: DataFrame, count: int) -> DataFrame:
    """The best ``count`` fork points of each group: (group_id, trunk, step, score) rows with eligible steps.

    Sorted by score descending, trunk and step; one per trunk first, then the rest.
    """
    best = Window.partitionBy("group_id", "trunk").orderBy(F.desc("score"), "step")
    ranked = trunks.withColumn("__again", F.row_number().over(best) > 1)
    place = Window.partitionBy("group_id").orderBy("__again", F.desc("score"), "trunk", "step")
    return ranked.withColumn("place", F.row_number().over(place)).where(F.col("place") <= count).drop("__again")


def terminal_reward(actions: DataFrame, episode: str, step: str, final: str) -> DataFrame:
    """Adds ``reward``: the episode's final reward on its last action, 0 elsewhere."""
    last = F.max(step).over(Window.partitionBy(episode))
    return actions.withColumn("__last", last).withColumn("reward", F.when(F.col(step) == F.col("__last"), F.col(final).cast("double")).otherwise(0.0)).drop("__last")
