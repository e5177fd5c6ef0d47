"""Identities of training groups, readiness of results, verdicts on runs and checks of goals and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scalars import same_loosely
from tidewright.functions.speech import stated
from tidewright.functions.spoken import said_loosely
from tidewright.operators.statistics import interval, resampled
from tidewright.sources.shared import written

# How far a model may fall behind its base.
MARGINS = {"success": -0.05, "repeat_failures": 0.05, "unknown_tools": 0.03, "step_limit": 0.05}


def with_identities(actions: DataFrame) -> DataFrame:
    """Adds sandbox_id, group_id, rollout_id, segment_id and a default loss_mask to actions.

    ``actions``: task_id, place (dataset or group index), policy_version, episode, action (both numbered from 0), tokens,
    and group_id and loss_mask where they are known.
    """
    group = F.coalesce("group_id", F.concat_ws(":", "task_id", F.coalesce("place", F.lit(0)), "policy_version"))
    rows = actions.withColumn("group_id", group).withColumn("rollout_id", F.concat(F.col("group_id"), F.lit("/rollout-"), "episode"))
    mask = F.coalesce("loss_mask", F.transform("tokens", lambda _: F.lit(1)))
    return rows.withColumn("segment_id", F.concat(F.col("rollout_id"), F.lit("/segment-"), "action")).withColumn("loss_mask", mask).withColumn("sandbox_id", F.col("task_id"))


def identity_problems(actions: DataFrame, groups: DataFrame, episodes: DataFrame) -> DataFrame:
    """group, segment_id and problem of actions whose identities are not those of the group and episode that hold them.

    ``groups``: group (where it is stored), task_id, group_id, policy_version. ``episodes``: group, episode, rollout_id. ``actions``:
    group, episode, sandbox_id, group_id, rollout_id, segment_id, policy_version. A sandbox, group, rollout or policy version that
    differs or is null is a problem each, and so is a segment that the group holds twice.
    """
    own = groups.select("group", F.col("task_id").alias("__sandbox"), F.col("group_id").alias("__group"), F.col("policy_version").alias("__policy"))
    rows = actions.join(own, "group", "left").join(episodes.select("group", "episode", F.col("rollout_id").alias("__rollout")), ["group", "episode"], "left")
    differs = lambda a, b, text: F.when(~F.coalesce(F.col(a) == F.col(b), F.lit(False)), text)
    found = F.array_compact(F.array(differs("sandbox_id", "__sandbox", "another sandbox"), differs("group_id", "__group", "another group"), differs("rollout_id", "__rollout", "another rollout"), differs("policy_version", "__policy", "another policy version")))
    twice = actions.groupBy("group", "segment_id").agg(F.count("*").alias("n")).where("n > 1").select("group", "segment_id", F.lit("repeated segment").alias("problem"))
    return rows.select("group", "segment_id", F.explode(found).alias("problem")).unionByName(twice)


def ready_results(results: DataFrame, attempts: DataFrame, excluded: DataFrame) -> DataFrame:
    """Results (dataset_index, attempt, finished_at) that are not excluded and of their job's current attempt (0 if none is given)."""
    current = attempts.select("dataset_index", F.col("attempt").alias("__a"))
    return results.join(excluded.select("dataset_index").distinct(), "dataset_index", "left_anti").join(current, "dataset_index", "left").where(F.col("attempt") == F.coalesce("__a", F.lit(0))).drop("__a")


def ready_minibatches(results: DataFrame, jobs: DataFrame, size: int, batch: str = "batch") -> DataFrame:
    """Adds minibatch: results of a batch by time of arrival, ``size`` in each; the last may be smaller once all its jobs are there.

    ``jobs`` (batch, dataset_index) are what is scheduled; results that cannot go yet are left out.
    """
    place = F.row_number().over(Window.partitionBy(batch).orderBy("finished_at", "dataset_index")) - 1
    rows = results.join(jobs.groupBy(batch).agg(F.count("*").alias("__jobs")), batch).withColumn("minibatch", F.floor(place / size))
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy(batch, "minibatch"))).withColumn("__all", F.count("*").over(Window.partitionBy(batch)))
    return rows.where((F.col("__n") == size) | (F.col("__all") == F.col("__jobs"))).drop("__n", "__all", "__jobs")


def ready_count(results: DataFrame, count: int, size: int, epoch: str = "epoch") -> DataFrame:
    """Adds minibatch to the first ``count`` results of each epoch by time of arrival, ``size`` in each; the last may be smaller.

    A mini-batch that is not full yet is left out, unless it is the last one and all ``count`` are there.
    """
    order = Window.partitionBy(epoch).orderBy("finished_at", "dataset_index")
    rows = results.withColumn("__p", F.row_number().over(order) - 1).where(F.col("__p") < count)
    rows = rows.withColumn("minibatch", F.floor(F.col("__p") / size)).withColumn("__n", F.count("*").over(Window.partitionBy(epoch)))
    full = F.least((F.col("minibatch") + 1) * size, F.lit(count)) <= F.col("__n")
    return rows.where(full).drop("__p", "__n")


def fork_segments(actions: DataFrame, forks: DataFrame) -> DataFrame:
    """trunk, segment, first and last action of each stretch of a trunk between its forks.

    ``actions``: trunk, action. ``forks``: trunk, step (the first action after the fork).
    """
    marked = actions.join(forks.select("trunk", F.col("step").alias("action"), F.lit(1).alias("__f")).distinct(), ["trunk", "action"], "left")
    number = F.coalesce(F.sum("__f").over(Window.partitionBy("trunk").orderBy("action")), F.lit(0))
    return marked.withColumn("segment", number).groupBy("trunk", "segment").agg(F.min("action").alias("first"), F.max("action").alias("last"))


def run_verdict(model: DataFrame, base: DataFrame) -> DataFrame:
    """metric, model, base and failed of the metrics (metric, value) that have a margin."""
    rows = model.select("metric", F.col("value").alias("model")).join(base.select("metric", F.col("value").alias("base")), "metric")
    margin = F.create_map(*[F.lit(x) for pair in MARGINS.items() for x in pair])
    gap, most = F.round(F.col("model") - F.col("base"), 9), F.try_element_at(margin, F.col("metric"))
    failed = F.when(F.col("metric") == "success", gap < most).otherwise(gap > most)
    return rows.where(most.isNotNull()).select("metric", "model", "base", failed.alias("failed"))


def paired_interval(base: DataFrame, model: DataFrame, key: str, value: str, *, draws: int = 2000, seed: int = 0) -> DataFrame:
    """low, high and p of the model's mean less the base's over resamples of the tasks that both played.

    Each mean is over the episodes of the drawn tasks, as many as each arm has of them. p is twice the lesser share of draws on
    one side of zero.
    """
    arm = lambda rows, side: rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.sum(F.col(value).cast("double")).alias(f"{side}_s"), F.count("*").alias(f"{side}_n"))
    tasks = arm(base, "a").join(arm(model, "b"), key)
    means = resampled(tasks, [key], {"a": ("a_s", "a_n"), "b": ("b_s", "b_n")}, draws=draws, seed=seed).select("draw", (F.col("b") - F.col("a")).alias("mean"))
    below, above = F.avg((F.col("mean") <= 0).cast("int")), F.avg((F.col("mean") >= 0).cast("int"))
    p = means.agg(F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"))
    # Both sides have one row.
    return interval(means).withColumn("__one", F.lit(1)).join(p.withColumn("__one", F.lit(1)), "__one").drop("__one")


def update_kl(tokens: DataFrame) -> DataFrame:
    """kl: over samples by weight, the mean of exp(d) - 1 - d over trained tokens, d being the new less the old log-probability.

    ``tokens``: sample_id, weight, old_logp, new_logp, trained.
    """
    d = F.col("new_logp") - F.col("old_logp")
    each = tokens.groupBy("sample_id").agg(F.first("weight").alias("w"), F.avg(F.when(F.col("trained"), F.exp(d) - 1 - d)).alias("k"))
    return each.agg((F.sum(F.col("w") * F.col("k")) / F.sum("w")).alias("kl"))


def write_failures(matches: DataFrame, top: int = 10) -> DataFrame:
    """kind, item and n: match kinds, and the most frequent differing arguments and missing tools (a report's top)."""
    kinds = matches.groupBy(F.col("kind")).agg(F.count("*").alias("n")).select(F.lit("match").alias("kind"), F.col("kind").alias("item"), "n")

    def most(rows: DataFrame, label: str) -> DataFrame:
        return rows.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(top).select(F.lit(label).alias("kind"), "item", "n")

    differing = matches.where("kind = 'arguments'").select(F.explode("differing").alias("item"))
    missing = matches.where("kind = 'missing'").select(F.col("name").alias("item"))
    return kinds.unionByName(most(differing, "argument")).unionByName(most(missing, "tool"))


def leaf_gaps(leaves: DataFrame, examples: int = 3) -> DataFrame:
    """kind, type, n and the first examples of unmatched leaves: why each was not matched.

    ``leaves``: type (integer, number, string, ...), expected, actual (texts, null where there is none), speech (what the assistant
    said). A value is said or not by ``said_loosely``; one equal loosely to the extracted one differs in form only.
    """
    rows = leaves.withColumn("__stated", stated(F.col("speech")))
    said = said_loosely(F.col("speech"), F.col("__stated"), F.col("expected"), F.col("type"))
    rows = rows.withColumn("__said", said)
    none, alike = F.col("actual").isNull(), same_loosely(F.col("expected"), F.col("actual"))
    kind = F.when(F.col("expected").isNull(), "nothing expected").when(none & F.col("__said"), "said but not extracted").when(none, "not said").when(alike, "another form").when(F.col("__said"), "said, another value extracted").otherwise("wrong")
    # Written once: both what is counted and what is shown read it, and the forms of a value are many.
    rows = written(rows.select(kind.alias("kind"), "type", F.concat_ws(" -> ", "expected", "actual").alias("example")))
    place = F.row_number().over(Window.partitionBy("kind", "type").orderBy("example"))
    few = rows.withColumn("__k", place).where(F.col("__k") <= examples).groupBy("kind", "type").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return rows.groupBy("kind", "type").agg(F.count("*").alias("n")).join(few, ["kind", "type"])


def goal_problems(tasks: DataFrame, goals: DataFrame, processes: DataFrame) -> DataFrame:
    """task_id and problem of the goals (task_id, process, params: array of names) of all ``tasks`` (task_id).

    A task has one to three goals; otherwise nothing else is said of it. Their processes are known, and so are all parameters.
    ``processes``: process, params (array of names).
    """
    counts = tasks.select("task_id").distinct().join(goals.groupBy("task_id").agg(F.count("*").alias("n")), "task_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    off = counts.where(~F.col("n").between(1, 3)).select("task_id", F.lit("not one to three goals").alias("problem"))
    known = goals.join(off.select("task_id"), "task_id", "left_anti").join(processes.select("process", F.col("params").alias("__p")), "process", "left")
    strange = F.array_sort(F.array_except(F.coalesce("params", F.expr("cast(array() as array<string>)")), "__p"))
    text = F.when(F.col("__p").isNull(), F.concat(F.lit("unknown process "), F.coalesce("process", F.lit("null")))).when(F.size(strange) > 0, F.concat(F.lit("unknown parameters of "), "process", F.lit(": "), F.array_join(strange, ", ")))
    return off.unionByName(known.select("task_id", text.alias("problem")).where("problem is not null").distinct())


def alternative_problems(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """task_id, number and problem of alternatives to the main outcome of a task.

    ``outcomes``: task_id, number (0: the main one, from 1 on the alternatives), outcome (text of answer and state), changes (rows
    of the world that it changes), answer_problems (array, by the schema). More alternatives than ``most`` are one problem, of
    number 0. Else an alternative must conform to the schema, repeat no outcome before it, the main one included, and change the
    world where the main one does.
    """
    size = outcomes.groupBy("task_id").agg(F.count(F.when(F.col("number") > 0, 1)).alias("n"), F.max(F.when(F.col("number") == 0, F.col("changes"))).alias("main"))
    many = size.where(F.col("n") > most).select("task_id", F.lit(0).alias("number"), F.lit("too many alternatives").alias("problem"))
    first = outcomes.groupBy("task_id", "outcome").agg(F.min("number").alias("first"))
    rows = outcomes.where("number > 0").join(size.where(F.col("n") <= most), "task_id").join(first, ["task_id", "outcome"])
    texts = F.concat(
        F.coalesce("answer_problems", F.expr("cast(array() as array<string>)")),
        F.array_compact(F.array(F.when(F.col("first") < F.col("number"), "repeats another outcome"), F.when((F.col("main") > 0) & (F.col("changes") == 0), "leaves the world unchanged although the main outcome changes it"))),
    )
    return rows.select("task_id", F.col("number").cast("int").alias("number"), F.explode(texts).alias("problem")).unionByName(many)


def refusals(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """The tasks (task_id, shape) whose shape asks for a write and whose expected state (``changes``: task_id, rows changed) is the initial one."""
    changed = changes.where("changes > 0").select("task_id").distinct()
    return tasks.where(F.col("shape").isin("single_write", "complex")).join(changed, "task_id", "left_anti")


def cascades(steps: DataFrame) -> DataFrame:
    """task_id, world, skipped approvals and steps of denials after which the reference drops what it did when all was approved.

    ``steps``: task_id, world (original, or flip:<approval>), step (``confirm <approval>`` or a tool), n. Denials that the original
    never asked for are left out, and so is the denied confirmation itself.
    """
    own = lambda world, row: F.collect_list(F.when(world, F.struct(*row)))
    held = steps.where("task_id is not null").groupBy("task_id").agg(own(F.col("world") == "original", ["step", "n"]).alias("__o"), own(F.col("world").startswith("flip:"), ["world", "step", "n"]).alias("__f"))
    asked = F.filter(F.array_distinct(F.transform("__f", lambda f: f["world"])), lambda w: F.exists("__o", lambda o: o["step"] == F.concat(F.lit("confirm "), F.substring(w, 6, 200))))
    flips = held.select("task_id", "__o", "__f", F.explode(asked).alias("world"))
    taken = flips.withColumn("__f", F.filter("__f", lambda f: f["world"] == F.col("world"))).withColumn("__denied", F.concat(F.lit("confirm "), F.substring("world", 6, 200)))
    kept = lambda o: F.coalesce(F.exists("__f", lambda f: (f["step"] == o["step"]) & (f["n"] >= o["n"])), F.lit(False))
    gone = F.transform(F.filter("__o", lambda o: (o["step"] != F.col("__denied")) & (o["n"] > 0) & ~kept(o)), lambda o: o["step"])
    lost = taken.select("task_id", "world", F.array_sort(gone).alias("steps")).where("size(steps) > 0")
    approvals = F.transform(F.filter("steps", lambda s: s.startswith("confirm ")), lambda s: F.substring(s, 9, 200))
    return lost.select("task_id", "world", F.array_sort(approvals).alias("approvals"), "steps")


def insensitive_goals(probes: DataFrame) -> DataFrame:
    """task_id and parameter of goals whose changed values (task_id, parameter, answer, state) never change the answer or the state."""
    return probes.groupBy("task_id", "parameter").agg(F.count_distinct("answer").alias("a"), F.count_distinct("state").alias("s")).where("a <= 1 and s <= 1").select("task_id", "parameter")


def approval_problems(worlds: DataFrame) -> DataFrame:
    """task_id, world and key of approval worlds (task_id, world, approved, confirmed) whose confirmed key is not the approved one."""
    return worlds.where(~F.col("approved").eqNullSafe(F.col("confirmed"))).select("task_id", "world", F.col("approved").alias("key"))


def run_status(status: Column, code: Column, tokens: Column, refused: Column) -> Column:
    """A session that was never served is infrastructure_error: refused or without a token, after a failed exit or a timeout."""
    unserved = refused | (F.coalesce(tokens, F.lit(0)) == 0)
    return F.when(unserved & (((status == "exited") & (code != 0)) | (status == "timeout")), "infrastructure_error").otherwise(status)
