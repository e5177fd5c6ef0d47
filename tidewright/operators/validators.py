"""Validators: each adds ``problems``, an array of texts that is empty for a valid row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import scalars as S


def with_problems(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds the texts of the rules whose condition is true; an unknown condition counts as true."""
    return rows.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for text, bad in rules.items()])))


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("problems") == 0).drop("problems")


def requests(rows: DataFrame, categories: tuple[str, ...] = ("direct_response", "simple_agentic", "multi_step_agentic")) -> DataFrame:
    """Requests: id, category, title, user_request, rules (array), language, clock (null, a number or a calendar text)."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    clock = F.col("clock").isNotNull() & F.col("clock").try_cast("long").isNull() & ~S.is_calendar(F.col("clock"))
    return with_problems(
        rows,
        {
            "id is missing": blank("id"),
            "title is missing": blank("title"),
            "user request is missing": blank("user_request"),
            "unknown category": ~F.col("category").isin(*categories),
            "no rules": F.coalesce(F.size("rules"), F.lit(0)) == 0,
            "unknown language": ~F.col("language").isin("zh", "en"),
            "bad clock": clock,
        },
    )


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """table, row_id and n of ids that occur more than once in their table."""
    return rows.where("row_id is not null").groupBy("table", "row_id").agg(F.count("*").alias("n")).where("n > 1")


def dangling_events(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Events that name a row that is not there."""
    return events.join(rows.select("table", "row_id").distinct(), ["table", "row_id"], "left_anti")


def schema_leaves(leaves: DataFrame) -> DataFrame:
    """Answer-schema leaves (path, type, nullable, enum, order, graded): types, enums and order."""
    return with_problems(
        leaves,
        {
            "unknown type": ~F.col("type").isin("string", "integer", "number", "boolean", "array", "object"),
            "enum on another type than string": F.coalesce((F.size("enum") > 0) & (F.col("type") != "string"), F.lit(False)),
            "array without order": F.coalesce((F.col("type") == "array") & ~F.coalesce(F.col("order").isin("exact", "any"), F.lit(False)), F.lit(False)),
            "money must be an integer": F.coalesce(F.regexp_like("path", F.lit("(?i)(amount|price|fee|total|cost|refund)")) & (F.col("type") == "number"), F.lit(False)),
        },
    )


def schema_size(leaves: DataFrame, fields: int = 5, values: int = 8) -> DataFrame:
    """schema_id and problems: at most so many graded fields and graded values."""
    graded = leaves.where(F.coalesce("graded", F.lit(True)))
    counts = graded.groupBy("schema_id").agg(F.count_distinct(F.substring_index("path", ".", 1)).alias("f"), F.count("*").alias("v"))
    return with_problems(counts, {"too many graded fields": F.col("f") > fields, "too many graded values": F.col("v") > values, "nothing is graded": F.col("v") == 0}).drop("f", "v")


def values(rows: DataFrame) -> DataFrame:
    """Leaf values (type, nullable, enum, value as text, json_type) against their type."""
    whole = F.col("value").try_cast("double").isNotNull() & (F.col("value").try_cast("double") == F.floor(F.col("value").try_cast("double")))
    given = F.col("value").isNotNull()
    return with_problems(
        rows,
        {
            "null not allowed": ~given & ~F.coalesce("nullable", F.lit(False)),
            "wrong type": F.when(
                given,
                F.when(F.col("type") == "integer", ~((F.col("json_type") == "number") & F.coalesce(whole, F.lit(False))))
                .when(F.col("type") == "number", F.col("json_type") != "number")
                .otherwise(F.col("json_type") != F.col("type")),
            ).otherwise(False),
            "not in enum": F.coalesce(given & (F.size("enum") > 0) & ~F.array_contains("enum", F.col("value")), F.lit(False)),
        },
    )


def key_sets(rows: DataFrame, wanted: str, given: str) -> DataFrame:
    """Adds problems for keys (arrays) that are missing or not asked for."""
    lacking, extra = F.array_sort(F.array_except(wanted, given)), F.array_sort(F.array_except(given, wanted))
    text = lambda label, keys: F.when(F.size(keys) > 0, F.concat(F.lit(label), F.array_join(keys, ", ")))
    return rows.withColumn("problems", F.array_compact(F.array(text("missing: ", lacking), text("unexpected: ", extra))))


def shape_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """table and row_id of rows (cells: map) whose column set differs from before, or whose table is new or gone."""
    shape = lambda d: d.select("table", F.array_sort(F.map_keys("cells")).alias("k"))
    old = shape(before).distinct()
    strange = after.select("table", "row_id", F.array_sort(F.map_keys("cells")).alias("k")).join(old, ["table", "k"], "left_anti").select("table", "row_id")
    gone = before.select("table").distinct().join(after.select("table").distinct(), "table", "left_anti").select("table", F.lit(None).cast("string").alias("row_id"))
    return strange.unionByName(gone)


def groups(rows: DataFrame) -> DataFrame:
    """Training groups (schema_version, task_identity, wanted_identity, split, policy_version, episodes with seed, reward,
    terminated, bootstrap_prompt, finish_reason, actions with prompt, tokens, logp)."""
    e = F.col("episodes")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    each_action = lambda test: F.forall(e, lambda x: F.forall(x["actions"], test))
    return with_problems(
        rows,
        {
            "unsupported version": ~F.col("schema_version").isin(2, 3),
            "task is absent, changed or not for training": ~(F.col("task_identity").eqNullSafe(F.col("wanted_identity")) & (F.col("split") == "train")),
            "bad policy version": F.col("policy_version") < 0,
            "no episodes": F.size(e) < 1,
            "several seeds": F.size(F.array_distinct(F.transform(e, lambda x: x["seed"]))) > 1,
            "empty episode": F.exists(e, lambda x: (F.size(x["actions"]) == 0) & ~x["finish_reason"].eqNullSafe("context_limit")),
            "reward is not finite": F.exists(e, lambda x: ~finite(x["reward"])),
            "truncated without its next context": F.exists(e, lambda x: ~x["terminated"] & (F.coalesce(F.size(x["bootstrap_prompt"]), F.lit(0)) < 1)),
            "tokens and log-probabilities are not aligned": ~each_action(lambda a: (F.size(a["tokens"]) > 0) & (F.size(a["prompt"]) > 0) & (F.size(a["tokens"]) == F.size(a["logp"]))),
            "bad token": ~each_action(lambda a: F.forall(F.concat(a["prompt"], a["tokens"]), lambda t: t >= 0)),
            "bad log-probability": ~each_action(lambda a: F.forall(a["logp"], lambda p: finite(p) & (p <= 1e-5))),
        },
    )


def segments(rows: DataFrame) -> DataFrame:
    """Training segments (prompt, tokens, logp, loss_mask): alignment and a 0/1 mask with at least one 1."""
    mask = F.coalesce("loss_mask", F.transform("tokens", lambda _: F.lit(1)))
    return with_problems(
        rows,
        {
            "not aligned": (F.size("tokens") < 1) | (F.size("tokens") != F.size("logp")) | (F.size("tokens") != F.size(mask)),
            "mask is not 0 or 1": ~F.forall(mask, lambda m: m.isin(0, 1)),
            "nothing is trained": ~F.exists(mask, lambda m: m == 1),
        },
    )


def admission(*, empty: Column, lag: Column, max_lag: int, zero_variance: Column, drift: Column) -> Column:
    """Why a group is not trained on, in this order: empty actions, policy age, equal rewards, importance drift; else null."""
    return F.when(empty, "empty_actions").when(~lag.between(0, max_lag), "policy_age").when(zero_variance, "zero_reward_variance").when(drift, "importance_drift")


def rejection_action(reason: Column, policy: Column, attempt: Column, most: int) -> Column:
    """skip, retry or fail. An empty context always skips; only equal rewards follow the policy (skip, fail, retry_skip,
    retry_fail), which retries while attempts are left; other reasons retry, then fail."""
    again = attempt + 1 < most
    by_policy = F.when(policy.isin("skip", "fail"), policy).when(again, "retry").when(policy == "retry_skip", "skip").otherwise("fail")
    return F.when(reason == "context_limit_empty", "skip").when(reason == "zero_reward_variance", by_policy).when(reason.isNotNull(), F.when(again, "retry").otherwise("fail"))


def exclusion(rows: DataFrame) -> DataFrame:
    """Adds reason (null: trainable) for tasks: the first of not built, build failed, too easy, image, policy gate.

    ``rows``: status, training_ready, failure_class, calls, floor, wants_image, image, policy_k, gate, successes.
    """
    gate = F.when(F.col("gate") == "unsolved", "policy gate: unsolved").when((F.col("gate") == "unextractable") & (F.coalesce("successes", F.lit(0)) == 0), "policy gate: unreadable").when(
        ~F.coalesce(F.col("gate").isin("passed", "unextractable"), F.lit(False)), F.concat(F.lit("policy gate not passed: "), F.coalesce("gate", F.lit("not run")))
    )
    reason = (
        F.when(F.col("status").isNull(), "not built")
        .when(~F.coalesce("training_ready", F.lit(False)), F.concat(F.lit("build failed: "), F.coalesce("failure_class", F.lit("unknown"))))
        .when(F.coalesce(F.col("calls") < F.col("floor"), F.lit(False)), "too easy")
        .when(F.coalesce("wants_image", F.lit(False)) & F.col("image").isNull(), "image not verified")
        .otherwise(F.when(F.col("policy_k") > 0, gate))
    )
    return rows.withColumn("reason", reason)


def simulation_outcome(reward: Column, termination: Column, db: Column, communicate: Column) -> Column:
    """pass, the reason of an early end, db, communicate or nl: the first that explains a simulation."""
    early = termination.isin("infrastructure_error", "max_steps", "too_many_errors")
    return (
        F.when(F.coalesce(reward, F.lit(0.0)) >= 1 - 1e-9, "pass")
        .when(early, termination)
        .when(F.coalesce(db, F.lit(1.0)) < 1, "db")
        .when(F.coalesce(communicate, F.lit(1.0)) < 1, "communicate")
        .otherwise("nl")
    )


def rubric(criteria: DataFrame) -> DataFrame:
    """rubric_id and problems: three to six criteria of weight 1 to 5 with a quoted basis, distinct names.

    ``criteria``: rubric_id, cid, weight, basis, request.
    """
    held = criteria.groupBy("rubric_id").agg(
        F.count("*").alias("n"), F.count_distinct("cid").alias("d"), F.bool_and(F.col("weight").between(1, 5)).alias("w"), F.bool_and(S.quoted(F.col("basis"), F.col("request"))).alias("q")
    )
    return with_problems(held, {"not 3 to 6 criteria": ~F.col("n").between(3, 6), "repeated criterion": F.col("n") != F.col("d"), "weight not 1 to 5": ~F.col("w"), "basis is not quoted": ~F.col("q")}).select("rubric_id", "problems")


def isolation_violations(lines: DataFrame, inside: str, outside: str, show: int = 5) -> DataFrame:
    """The first ``show`` log lines that match ``outside`` but not ``inside``; a report, so the limit is the feature."""
    return lines.where(F.regexp_like("line", F.lit(outside)) & ~F.regexp_like("line", F.lit(inside))).orderBy("number").limit(show)
