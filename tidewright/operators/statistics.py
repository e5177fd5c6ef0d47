"""Cluster bootstrap, paired comparison, rank test and verdicts over per-task results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.ordering import hash_order
from tidewright.operators.ordered import running


#: The Poisson distribution of mean 1 up to k, as shares of 2 ** 32.
POISSON = [int((1 << 32) * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(10)]


def resampled(tasks: DataFrame, key: list[str], measures: dict[str, tuple[str, str]], *, draws: int = 2000, seed: int = 0) -> DataFrame:
    """draw and, for each (name: (total, count)) of ``measures``, the mean of that draw's resample of the tasks.

    ``tasks`` has one row a task with the total and the number of its episodes, so a resample averages over the episodes of
    the drawn tasks, however many each has. A task's multiplicity in a draw is Poisson of mean 1 by the hash of seed, draw and
    task, as in resampling on streams: totals of partitions add up, and nothing of size draws by tasks is shuffled or stored.
    One hash serves eight draws. A draw that takes no task of a measure has no mean.
    """
    digits = hash_order(seed, "resample", "__b", *key)
    weight = lambda i: sum((F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("long") >= F.lit(t)).cast("int") for t in POISSON)
    spread = tasks.select(*key, *dict.fromkeys(c for pair in measures.values() for c in pair), F.explode(F.sequence(F.lit(0), F.lit(-(-draws // 8) - 1))).alias("__b")).withColumn("__h", digits)
    spread = spread.withColumns({f"__w{i}": weight(i) for i in range(8)})
    sums = [F.sum(F.col(f"__w{i}") * F.col(c)).alias(f"__{k}_{i}_{name}") for i in range(8) for name, pair in measures.items() for k, c in enumerate(pair)]
    folded = spread.groupBy("__b").agg(*sums)
    mean = lambda i, name: F.when(F.col(f"__1_{i}_{name}") > 0, F.col(f"__0_{i}_{name}") / F.col(f"__1_{i}_{name}")).alias(name)
    each = F.array(*[F.struct((F.col("__b") * 8 + i).alias("draw"), *[mean(i, name) for name in measures]) for i in range(8)])
    return folded.select(F.inline(each)).where(F.col("draw") < draws)


def bootstrap_means(episodes: DataFrame, key: str, value: str, *, draws: int = 2000, seed: int = 0) -> DataFrame:
    """draw and mean of the values of ``episodes`` over ``draws`` resamples of the tasks named by ``key``; null values are no episodes."""
    tasks = episodes.where(F.col(value).isNotNull()).groupBy(key).agg(F.sum(F.col(value).cast("double")).alias("__s"), F.count("*").alias("__n"))
    return resampled(tasks, [key], {"mean": ("__s", "__n")}, draws=draws, seed=seed)


def interval(means: DataFrame, share: float = 0.95) -> DataFrame:
    """low and high: of the n sorted means (a row a draw) those at int(n * tail) and int(n * (1 - tail)) - 1."""
    tail = (1 - share) / 2
    at = lambda x: F.floor(F.size("__m") * F.lit(x) + 1e-9).cast("int")
    out = means.agg(F.array_sort(F.collect_list("mean")).alias("__m"))
    return out.select(F.get("__m", at(tail)).alias("low"), F.get("__m", at(1 - tail) - 1).alias("high"))


def paired_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and ``difference`` (b - a) of the tasks that both have."""
    left = a.select(*keys, F.col(value).alias("__a"))
    return left.join(b.select(*keys, F.col(value).alias("__b")), keys).select(*keys, (F.col("__b") - F.col("__a")).alias("difference"))


def wilcoxon(differences: DataFrame, column: str = "difference", zero: float = 1e-12) -> DataFrame:
    """n, w, z and p of the signed-rank test: zeros dropped, average ranks for ties, no tie term in sigma, two-sided.

    Ties are counted first, and the distinct sizes are ranked range by range, so neither ties nor sizes meet in one task.
    """
    rows = differences.where(F.abs(column) > zero).select(F.col(column).alias("__d"), F.abs(column).alias("__a"))
    sizes = rows.groupBy("__a").agg(F.count("*").alias("__c"), F.count(F.when(F.col("__d") > 0, 1)).alias("__p"))
    ranked = running(sizes, ["__a"], {"__f": ("sum", F.col("__c"))}).select("__c", "__p", (F.coalesce("__f", F.lit(0)) + (F.col("__c") + 1) / 2.0).alias("__r"))
    total = ranked.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("__p") * F.col("__r")), F.lit(0.0)).alias("w"))
    n = F.col("n").cast("double")
    z = F.when(n > 0, (F.col("w") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).otherwise(0.0)
    return total.withColumn("z", z).withColumn("p", F.when(n > 0, complementary_error(F.abs("z") / math.sqrt(2))).otherwise(1.0))


def complementary_error(x: Column) -> Column:
    """erfc, which Spark lacks, over Arrow batches."""

    @F.arrow_udf("double")
    def of(values):
        import pyarrow as pa

        return pa.array([None if v is None else math.erfc(v) for v in values.to_pylist()], pa.float64())

    return of(x)


def outcome_rates(results: DataFrame, keys: list[str], success: str) -> DataFrame:
    """keys, trials, rate and pass_all (whether all trials of the key succeeded)."""
    hit = F.col(success).cast("int")
    return results.groupBy(*keys).agg(F.count("*").alias("trials"), F.avg(hit).alias("rate"), (F.min(hit) == 1).alias("pass_all"))


def report_table(rates: DataFrame, rate: str, domain: str, write: str) -> DataFrame:
    """domain, needs_write, tasks and mean rate: overall, by domain and by write need, as grouping sets."""
    sets = rates.groupingSets([[], [F.col(domain)], [F.col(write)]], F.col(domain), F.col(write))
    return sets.agg(F.count("*").alias("tasks"), F.avg(rate).alias("mean_rate"), F.grouping_id().cast("long").alias("level"))
