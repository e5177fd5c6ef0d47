"""Partial-credit scores, rewards and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import scalars as S

BUSINESS, EFFICIENCY = 0.95, 0.05


def leaf_matches(leaves: DataFrame) -> DataFrame:
    """Adds matched to leaves (expected, actual: text values): equal in normal form; an unstated internal id is exempt.

    ``internal`` (boolean) marks an internal id that the user never saw.
    """
    unstated = F.col("internal") & F.coalesce(F.trim("actual") == "", F.lit(True))
    same = S.normal_text(F.col("expected")) == S.normal_text(F.col("actual"))
    return leaves.withColumn("exempt", unstated).withColumn("matched", F.coalesce(same, F.lit(False)) | unstated)


def object_scores(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """keys and score of one level of objects from their graded leaves (matched, exempt, required, expected).

    All matched gives 1. Else credit is for substance only: leaves that are neither required (enums, booleans, constants)
    nor exempt, with something expected; it halves if a required leaf is wrong. Without substance it is half the share of
    matched leaves if all required ones match, else 0.
    """
    hit = F.col("matched").cast("int")
    substance = ~F.col("required") & ~F.col("exempt") & F.col("expected").isNotNull()
    held = leaves.groupBy(*keys).agg(
        F.min(hit).alias("__all"),
        F.coalesce(F.min(F.when(F.col("required"), hit)), F.lit(1)).alias("__req"),
        F.avg(F.when(substance, hit)).alias("__sub"),
        F.avg(hit).alias("__any"),
    )
    without = F.when(F.col("__req") == 1, 0.5 * F.col("__any")).otherwise(0.0)
    credit = F.when(F.col("__sub").isNull(), without).otherwise(F.when(F.col("__req") == 1, F.col("__sub")).otherwise(0.5 * F.col("__sub")))
    return held.select(*keys, F.when(F.col("__all") == 1, 1.0).otherwise(credit).alias("score"))


def reward(
    *, has_effects: Column, state_ok: Column, fields: Column, scores: Column, all_right: Column, calls: Column, reference: Column, violations: Column, well_formed: Column
) -> dict[str, Column]:
    """success, efficiency and reward of an episode.

    ``fields`` graded fields with the sum ``scores``; half of the business share is the state where the task has effects.
    A read-only task that changed the state earns nothing for its fields; a violation earns nothing at all.
    """
    state_weight = F.when(has_effects, BUSINESS / 2).otherwise(0.0)
    field_weight = F.when(~has_effects & ~state_ok, 0.0).otherwise((BUSINESS - state_weight) / F.greatest(F.lit(1), fields))
    business = F.when(state_ok, state_weight).otherwise(0.0) + field_weight * scores
    full, none = 2 * reference + 2, 4 * reference + 4
    efficiency = F.when(calls <= full, 1.0).otherwise(F.greatest(F.lit(0.0), (none - calls) / (none - full)))
    safe = violations == 0
    success = safe & state_ok & all_right & well_formed
    return {
        "success": success,
        "efficiency": F.bround(efficiency, 6),
        "reward": F.when(safe, F.bround(business + F.when(success, EFFICIENCY * efficiency).otherwise(0.0), 6)).otherwise(0.0),
    }


def best_outcome(grades: DataFrame, keys: list[str]) -> DataFrame:
    """The best of the accepted outcomes: by success, reward, then the earliest ``outcome``."""
    order = F.struct(F.col("success").cast("int"), "reward", -F.col("outcome"))
    others = [c for c in grades.columns if c not in keys]
    return grades.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("b")).select(*keys, "b.*")


def rubric_score(levels: DataFrame, key: str) -> DataFrame:
    """key, score (weighted mean of level / 2) and gate (whether no gating criterion is 0)."""
    gate = F.bool_and(F.when(F.coalesce("gate", F.lit(False)), F.col("level") > 0))
    return levels.groupBy(key).agg((F.sum(F.col("weight") * F.col("level") / 2) / F.sum("weight")).alias("score"), F.coalesce(gate, F.lit(True)).alias("gate"))


def rubric_reward(score: Column, gate: Column, replied: Column, calls: Column, reference: Column, passing: float = 0.8) -> dict[str, Column]:
    full, none = 2 * reference + 2, 4 * reference + 4
    efficiency = F.when(calls <= full, 1.0).otherwise(F.greatest(F.lit(0.0), (none - calls) / (none - full)))
    counted = F.when(replied & gate, score).otherwise(0.0)
    success = counted >= passing
    return {"success": success, "reward": F.bround(BUSINESS * counted + F.when(success, EFFICIENCY * efficiency).otherwise(0.0), 6)}


def mutations(value: Column, kind: Column, choices: Column) -> Column:
    """Wrong values for a leaf: another choice of an enum, a number off by one, a flipped boolean, a marked text."""
    other = F.filter(choices, lambda c: c != value)
    number = F.array((value.try_cast("double") + 1).cast("string"), (value.try_cast("double") - 1).cast("string"))
    return (
        F.when(F.size(choices) > 0, other)
        .when(kind == "boolean", F.array(F.when(value == "true", "false").otherwise("true")))
        .when(kind.isin("integer", "number"), number)
        .otherwise(F.array(F.concat(value, F.lit("-x"))))
    )


def equivalents(value: Column, kind: Column) -> Column:
    """Other spellings of a leaf that must grade the same."""
    number = value.try_cast("double")
    spelled = F.array(F.format_string("%.2f", number), F.concat(F.lit("$"), F.format_string("%.2f", number)))
    stamped = F.array(F.replace(value, F.lit("T"), F.lit(" ")))
    return F.when(kind.isin("integer", "number") & number.isNotNull(), spelled).when(S.is_calendar(value), stamped).otherwise(F.array(F.upper(value), F.concat(F.lit(" "), value, F.lit(" "))))


def grader_errors(probes: DataFrame) -> DataFrame:
    """False positives and negatives of probes (expected, actual, should_pass), with their rates."""
    graded = probes.withColumn("__p", S.normal_text(F.col("expected")) == S.normal_text(F.col("actual")))
    return graded.agg(
        F.count("*").alias("probes"),
        F.count(F.when(F.col("__p") & ~F.col("should_pass"), 1)).alias("false_positives"),
        F.count(F.when(~F.col("__p") & F.col("should_pass"), 1)).alias("false_negatives"),
    )


def deep_scores(rows: DataFrame, schema: dict, *, expected: str = "expected", actual: str = "actual", known: str | None = None, names: str | None = None) -> DataFrame:
    """Adds scores (map of graded field to share) of nested JSON answers under an answer schema.

    ``known`` names a column of texts that the user knows (ids they never saw are then excused), ``names`` one of a map from
    names to the records that they stand for. The schema is small and compiled once; values are compared over Arrow batches,
    because order-any lists inside objects need a nested comparison that SQL cannot express. Flat answers are better served
    by object_scores.
    """
    import json

    text = json.dumps(schema)

    @F.arrow_udf("map<string,double>")
    def of(want, got, seen, called):
        import pyarrow as pa

        from tidewright.functions.answers import Scorer, tagged

        scorer = Scorer(json.loads(text))
        key = lambda n: tagged(None, n).partition(":")[2]
        rows = zip(want.to_pylist(), got.to_pylist(), seen.to_pylist(), called.to_pylist(), strict=True)
        return pa.array([list(scorer.scores(w, g, k, {key(a): r for a, r in n} if n else None).items()) for w, g, k, n in rows], pa.map_(pa.string(), pa.float64()))

    held = F.col(known) if known else F.lit(None).cast("array<string>")
    other = F.col(names) if names else F.lit(None).cast("map<string,string>")
    return rows.withColumn("scores", of(F.col(expected), F.col(actual), held, other))


def answer_problems(rows: DataFrame, schema: dict, answer: str = "answer") -> DataFrame:
    """Adds problems: what keeps a JSON answer from the schema's fields, in order; a text that is no JSON is no object."""
    import json

    text = json.dumps(schema)

    @F.arrow_udf("array<string>")
    def of(values):
        import pyarrow as pa

        from tidewright.functions.answers import answer_problems as check
        from tidewright.functions.answers import read

        fields = json.loads(text)["fields"]
        return pa.array([check(fields, read(v.as_py())) for v in values], pa.list_(pa.string()))

    return rows.withColumn("problems", of(F.col(answer)))


def answer_leaves(rows: DataFrame, schema: dict, answer: str = "answer") -> DataFrame:
    """One row for each graded leaf of each row's JSON answer: the other columns, path and value (JSON text)."""
    import json

    text = json.dumps(schema)

    @F.arrow_udf("array<struct<path:string,value:string>>")
    def of(values):
        import pyarrow as pa

        from tidewright.functions.answers import graded_leaves, read

        spec = {"type": "object", "properties": json.loads(text)["fields"]}
        found = lambda v: [{"path": p, "value": json.dumps(x)} for p, x in graded_leaves(spec, v)] if isinstance(v, dict) else []
        return pa.array([found(read(v.as_py())) for v in values], pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])))

    return rows.select(*[c for c in rows.columns if c != answer], F.inline(of(F.col(answer))))


def silenced(rows: DataFrame, schema: dict, answer: str = "answer") -> DataFrame:
    """Adds silent: the answer with nothing said (JSON text), a probe that must earn no credit; null where it is no object."""
    import json

    text = json.dumps(schema)

    @F.arrow_udf("string")
    def of(values):
        import pyarrow as pa

        from tidewright.functions.answers import read, silent

        spec = {"type": "object", "properties": json.loads(text)["fields"]}
        return pa.array([json.dumps(silent(spec, v)) if isinstance(v := read(t.as_py()), dict) else None for t in values], pa.string())

    return rows.withColumn("silent", of(F.col(answer)))
