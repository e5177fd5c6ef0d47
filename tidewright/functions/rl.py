"""Credit and objective mathematics over columns and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gae(rewards: Column, values: Column, terminated: Column, bootstrap: Column, discounts: Column, lambdas: Column) -> Column:
    """Generalised advantages of aligned arrays, by one backward fold; the return of an element is its advantage plus its value."""
    steps = F.reverse(
        F.arrays_zip(rewards.alias("r"), values.alias("v"), terminated.alias("t"), discounts.alias("d"), lambdas.alias("l"))
    )
    start = F.struct(
        bootstrap.cast("double").alias("next"), F.lit(0.0).alias("carry"), F.expr("cast(array() as array<double>)").alias("out")
    )

    def back(s: Column, x: Column) -> Column:
        d = F.when(x["t"], 0.0).otherwise(x["d"])
        carry = x["r"] + d * s["next"] - x["v"] + d * x["l"] * s["carry"]
        return F.struct(x["v"].alias("next"), carry.alias("carry"), F.array_append(s["out"], carry).alias("out"))

    return F.reverse(F.aggregate(steps, start, back, lambda s: s["out"]))


def constant(array: Column, value: float) -> Column:
    """An array of the same length that repeats a value."""
    return F.transform(array, lambda _: F.lit(float(value)))


def clipped_surrogate(new_logp: Column, old_logp: Column, advantage: Column, epsilon: float) -> Column:
    ratio = F.exp(new_logp - old_logp)
    return -F.least(ratio * advantage, F.greatest(F.least(ratio, F.lit(1 + epsilon)), F.lit(1 - epsilon)) * advantage)


def sampled_kl(new_logp: Column, reference_logp: Column) -> Column:
    d = reference_logp - new_logp
    return F.exp(d) - d - 1


def clipped_value_loss(value: Column, old_value: Column, target: Column, epsilon: float) -> Column:
    clipped = old_value + F.greatest(F.least(value - old_value, F.lit(epsilon)), F.lit(-epsilon))
    return 0.5 * F.greatest((value - target) * (value - target), (clipped - target) * (clipped - target))


def low_probability_mask(logp: Column, mask: Column, threshold: float) -> Column:
    """Loss mask (0/1 array) without tokens of probability at least ``threshold``, unless none would remain."""
    kept = F.zip_with(logp, mask, lambda p, m: F.when(F.exp(p) < threshold, m).otherwise(F.lit(0).cast("int")))
    left = F.aggregate(kept, F.lit(0), lambda s, x: s + x)
    return F.when(left > 0, kept).otherwise(mask)


def spread_weight(weight: Column, mask: Column) -> Column:
    """A weight shared equally by the masked tokens."""
    total = F.aggregate(mask, F.lit(0), lambda s, x: s + x)
    return F.transform(mask, lambda m: F.when(total > 0, weight * m / total).otherwise(0.0))


def importance_diagnostics(target: Column, behaviour: Column, epsilon: float = 0.2) -> Column:
    """Effective sample fraction, greatest log ratio and clip share of aligned log-probability arrays."""
    import math

    delta = F.zip_with(target, behaviour, lambda t, b: t - b)
    top, n = F.array_max(delta), F.size(delta)
    scaled = F.transform(delta, lambda d: F.exp(d - top))
    total = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x)
    squares = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x)
    outside = F.filter(delta, lambda d: (d < math.log1p(-epsilon)) | (d > math.log1p(epsilon)))
    return F.struct(
        (total * total / squares / n).alias("effective_sample_fraction"),
        F.array_max(F.transform(delta, lambda d: F.abs(d))).alias("max_abs_log_ratio"),
        (F.size(outside) / n).alias("importance_clip_fraction"),
    )
