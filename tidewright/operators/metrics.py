"""Group, evaluation, journal and interval summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordered import running


def zero_variance_kind(reward: str, success: Column) -> Column:
    """all_success, all_failure or equal_reward for a group whose rewards do not differ, else null; an aggregate."""
    same = F.max(reward) == F.min(reward)
    return F.when(same & F.bool_and(success), "all_success").when(same & F.bool_and(F.col(reward) <= 0), "all_failure").when(same, "equal_reward")


def group_metrics(episodes: DataFrame, group: str) -> DataFrame:
    """About twenty metrics of each group over all of its episodes, trainable or not.

    ``episodes``: reward, terminated, truncated (null: not terminated), context_limit, actions, tokens, tool_calls,
    token_limited (actions at the limit), protocol_errors.
    """
    won = F.col("terminated") & (F.col("reward") >= 1 - 1e-9)
    rate = lambda c: F.avg(c.cast("int"))
    n = F.count("*")
    return episodes.groupBy(group).agg(
        n.alias("episodes"),
        F.count(F.when(won, 1)).alias("reward_successes"),
        (1 - rate(won)).alias("reward_non_success_rate"),
        F.bool_and(won).alias("all_success_group"),
        F.bool_and(F.col("reward") <= 0).alias("all_failure_group"),
        (n >= 2).alias("grpo_group_eligible"),
        ((n >= 2) & (F.max("reward") - F.min("reward") < 1e-12)).alias("grpo_zero_advantage_group"),
        F.count(F.when((F.col("reward") >= 1 - 1e-9) & ~F.col("terminated"), 1)).alias("high_reward_unterminated"),
        F.avg("reward").alias("reward_mean"),
        F.stddev_pop("reward").alias("reward_std"),
        F.min("reward").alias("reward_min"),
        F.max("reward").alias("reward_max"),
        (F.max("reward") - F.min("reward")).alias("reward_range"),
        (F.max("reward") == F.min("reward")).alias("zero_reward_variance"),
        zero_variance_kind("reward", won).alias("zero_variance_kind"),
        rate(won).alias("success_rate"),
        rate(F.col("terminated")).alias("termination_rate"),
        rate(F.coalesce("truncated", ~F.col("terminated"))).alias("truncation_rate"),
        rate(F.coalesce("context_limit", F.lit(False))).alias("context_limit_rate"),
        F.avg("actions").alias("actions_mean"),
        F.sum("tokens").alias("generated_tokens"),
        F.avg("tokens").alias("tokens_per_episode"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("protocol_errors").alias("protocol_errors"),
        (F.sum("token_limited") / F.greatest(F.sum("actions"), F.lit(1))).alias("token_limit_rate"),
    )


def evaluation(episodes: DataFrame, task: str, split: str) -> DataFrame:
    """Mean reward and success by task, by split and overall, in one pass of grouping sets (level: grouping id)."""
    won = (F.col("terminated") & (F.col("reward") >= 1 - 1e-9)).cast("int")
    sets = episodes.groupingSets([[F.col(task)], [F.col(split)], []], F.col(task), F.col(split))
    return sets.agg(F.count("*").alias("episodes"), F.avg("reward").alias("mean_reward"), F.avg(won).alias("success_rate"), F.grouping_id().cast("long").alias("level"))


def pass_at_k(attempts: DataFrame, task: str, success: str, *, played: Column | None = None) -> DataFrame:
    """task, played, successes, rate, variance (population) and status (passed, unsolved or unplayed)."""
    counted = played if played is not None else F.lit(True)
    hit = F.when(counted, F.col(success).cast("int"))
    rows = attempts.groupBy(task).agg(F.count(hit).alias("played"), F.coalesce(F.sum(hit), F.lit(0)).alias("successes"), F.avg(hit).alias("rate"), F.var_pop(hit).alias("variance"))
    return rows.withColumn("status", F.when(F.col("played") == 0, "unplayed").when(F.col("successes") > 0, "passed").otherwise("unsolved"))


def learning_signals(records: DataFrame) -> DataFrame:
    """Totals and rates of a metric journal, overall (task_id null, total true) and by task.

    ``records``: event, task_id, dataset_index, attempt (null: 0), arrival, eligible, zero_advantage, all_success,
    successes, episodes, skipped, mini_batch. Received rollouts and quarantines count once per job, the first arrival;
    rates are null where nothing is below the line.
    """
    once = F.col("event").isin("rollout_received", "environment_quarantined")
    place = F.row_number().over(Window.partitionBy("event", "task_id", "dataset_index", F.coalesce("attempt", F.lit(0))).orderBy("arrival"))
    jobs = records.where(once).withColumn("__k", place).where("__k = 1").drop("__k")
    rows = jobs.unionByName(records.where(~once))
    got = F.col("event") == "rollout_received"
    measured = got & F.col("episodes").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    total = lambda c: F.coalesce(F.sum(F.when(got, F.col(c))), F.lit(0))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    out = rows.rollup("task_id").agg(
        F.grouping("task_id").cast("int").alias("total"),
        count(got).alias("rollout_groups"),
        count(got & F.col("episodes").isNull()).alias("unmeasured_groups"),
        total("episodes").alias("episodes"),
        total("successes").alias("successes"),
        count(measured & F.col("eligible")).alias("eligible_groups"),
        count(measured & F.col("eligible") & F.col("zero_advantage")).alias("zero_advantage_groups"),
        count(measured & F.col("all_success")).alias("all_success_groups"),
        count(measured).alias("measured_groups"),
        count(F.col("event") == "environment_quarantined").alias("quarantined_jobs"),
        count(F.col("event") == "optimizer_step").alias("optimizer_steps"),
        count(F.col("skipped").isNotNull()).alias("admission_rejections"),
        count(F.col("skipped").isNotNull() & F.col("mini_batch").isNotNull()).alias("optimizer_steps_skipped"),
    )
    out = out.withColumn("jobs", F.col("rollout_groups") + F.col("quarantined_jobs")).withColumn("steps", F.col("optimizer_steps") + F.col("optimizer_steps_skipped"))
    return out.select(
        "*",
        ratio("successes", "episodes").alias("reward_success_rate"),
        ratio("zero_advantage_groups", "eligible_groups").alias("grpo_zero_advantage_rate"),
        ratio("all_success_groups", "measured_groups").alias("all_success_group_rate"),
        ratio("optimizer_steps", "steps").alias("optimizer_step_execution_rate"),
        ratio("quarantined_jobs", "jobs").alias("quarantined_job_rate"),
    ).drop("jobs", "steps")


def weighted_metrics(rows: DataFrame, weight: str, metrics: list[str]) -> DataFrame:
    """Weighted sums of metrics; total_weight_ok says whether the weights add to 1 within 1e-6."""
    return rows.agg(*[F.sum(F.col(weight) * F.col(m)).alias(m) for m in metrics], (F.abs(F.sum(weight) - 1) <= 1e-6).alias("total_weight_ok"))


def stage_times(records: DataFrame) -> DataFrame:
    """kind, seconds and calls of timed routes, routes folded into kinds."""
    kind = F.when(F.col("route").startswith("/v1/tools/"), "tool").when(F.col("route").startswith("/v1/chat"), "chat").when(F.col("route").isNull(), "other").otherwise(F.regexp_extract("route", "^/?(?:v1/)?([a-z_]+)", 1))
    return records.groupBy(kind.alias("kind")).agg(F.sum("seconds").alias("seconds"), F.count("*").alias("calls"))


def differential(worlds: DataFrame, core: int) -> DataFrame:
    """Counts of world statuses, and passed: no mismatch or error, every plain world agrees, and at least core + 5 agree.

    ``worlds``: world, status, perturbed.
    """
    count = lambda s: F.count(F.when(F.col("status") == s, 1))
    plain = F.coalesce(F.bool_and(F.when(~F.col("perturbed"), F.col("status") == "agree")), F.lit(True))
    bad = F.count(F.when(F.col("status").isin("mismatch", "verifier_error", "env_error"), 1))
    return worlds.agg(*[count(s).alias(s) for s in ("agree", "mismatch", "verifier_error", "env_error", "invalid", "excluded")], ((bad == 0) & plain & (count("agree") >= core + 5)).alias("passed"))


def histogram(values: DataFrame, column: str, most: int = 20) -> DataFrame:
    """bin, count and the edges of min(most, n) equal bins, with the column's minimum, maximum, sum and sum of squares."""
    facts = values.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"), F.sum(column).alias("total"), F.sum(F.col(column) * F.col(column)).alias("squares")).first()
    bins = min(most, facts["n"] or 0)
    if not bins:
        return values.sparkSession.createDataFrame([], "bin int, n long, low double, high double, total double, squares double")
    low, width = float(facts["low"]), (float(facts["high"]) - float(facts["low"])) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
    rows = values.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda k: F.lit(low) + F.lit(width) * k
    return rows.select("bin", "n", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.lit(float(facts["total"])).alias("total"), F.lit(float(facts["squares"])).alias("squares"))


def best_so_far(evaluations: DataFrame, step: str, value: str) -> DataFrame:
    """Adds best (the greatest value up to the step) and improved (strictly above all before), for one evaluation a step."""
    before = F.col("__before")
    out = running(evaluations, [step], {"__before": ("max", F.col(value))})
    return out.withColumn("improved", before.isNull() | (F.col(value) > before)).withColumn("best", F.greatest(F.coalesce(before, F.col(value)), F.col(value))).drop("__before")


def constant_leaves(answers: DataFrame, least: int = 3) -> DataFrame:
    """field and property whose value is one and the same over at least ``least`` answers."""
    held = answers.groupBy("field", "property").agg(F.count("*").alias("answers"), F.min("value").alias("value"), F.max("value").alias("__x"))
    return held.where((F.col("answers") >= least) & F.col("value").eqNullSafe(F.col("__x"))).drop("__x")


def disagreements(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Counts by key with up to ``limit`` examples (column example), the least first."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("example"))
    total = F.count("*").over(Window.partitionBy(*keys))
    return rows.select(*keys, "example", place.alias("__k"), total.alias("n")).where(F.col("__k") <= limit).groupBy(*keys, "n").agg(F.array_sort(F.collect_list("example")).alias("examples"))
