"""Queries on caps, quotas, splits, schedules, replay and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.ordering import hash_order
from tidewright.operators import selection as L
from tidewright.operators import statistics as ST
from tidewright.sources import tables as T

TASKS = "tasks AS (SELECT doc_id, source, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


def _h(tag: str):
    return [hash_order(0, tag, "doc_id"), "doc_id"]


def per_task_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four good documents of each source: one of each language first, clean and long ones before others."""
    rows = T.tasks(spark, sf_dir).where("quality = 1")
    return L.per_task_cap(rows, "source", "lang", ["toxic", F.desc("n_chars"), "doc_id"], 4).select("source", "doc_id")


def direct_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short documents are at most 15% of the selection."""
    return L.share_quota(T.tasks(spark, sf_dir), F.col("n_chars") < 1000, 0.15, _h("direct")).select("doc_id")


def language_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English is at least 70% of the selection."""
    return L.language_quota(T.tasks(spark, sf_dir), F.col("lang") == "en", 0.7, _h("language")).select("doc_id")


def domain_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No source has more than 4% of the rows before capping."""
    return L.domain_cap(T.tasks(spark, sf_dir), "source", 0.04, _h("domain")).select("source", "doc_id")


def domain_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.domain_holdout(T.tasks(spark, sf_dir), "source", 0.15)


def assign_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.assign_eval(T.tasks(spark, sf_dir), "source", 0.2)


def epoch_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs of parts in batches of 16."""
    return L.epoch_schedule(T.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", epochs=3, batch=16, seed=7)


def weighted_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 draws of a supplier by balance and one of its nation's customers' orders."""
    nation = F.col("c_nationkey").cast("long")
    orders = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    entries = orders.select(nation.alias("task_id"), F.col("o_orderkey").alias("entry_id"))
    weights = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("task_id"), (F.col("n_nationkey") % 4 + 1).cast("double").alias("weight"))
    return L.weighted_replay(entries, weights, draws=500, seed=3)


def minibatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole customers in mini-batches of eight."""
    return L.minibatches(T.episodes(spark, sf_dir).select("group_id", "episode_id"), "group_id", 8, seed=1)


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95% interval of the mean reward of episodes, over 200 resamples of the customers, who have different numbers of them."""
    out = ST.interval(ST.bootstrap_means(T.episodes(spark, sf_dir), "group_id", "reward", draws=200, seed=5))
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def wilcoxon_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed ranks of urgent against low priority orders, by customer, on the rounded mean price."""
    e = T.episodes(spark, sf_dir)
    arm = lambda p: e.where(F.col("priority") == p).groupBy("group_id").agg(F.round(F.avg("price") / 1000).alias("v"))
    out = ST.wilcoxon(ST.paired_differences(arm("5-LOW"), arm("1-URGENT"), ["group_id"], "v"))
    return out.select("n", F.round("w", 6).alias("w"), F.round("z", 6).alias("z"))


def grouping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean success rate of customers: overall, by segment, and by whether they pay much."""
    e = T.episodes(spark, sf_dir).withColumn("won", F.col("reward") >= 1 - 1e-9)
    rates = ST.outcome_rates(e, ["group_id"], "won").join(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("domain"), (F.col("c_acctbal") > 5000).cast("int").alias("write")), "group_id")
    out = ST.report_table(rates, "rate", "domain", "write")
    return out.select("domain", F.coalesce("write", F.lit(-1)).alias("write"), "tasks", F.round("mean_rate", 6).alias("mean_rate"), "level")


H = lambda tag: f"sha256('0:{tag}:' || doc_id)"



def resamples(seed: str, draws: int) -> str:
    """w: draw, the columns of t (one row for each k) and the row's multiplicity w."""
    steps = " + ".join(f"(u >= {t})::INT" for t in ST.POISSON)
    return f"""h AS (SELECT t.*, b, sha256('{seed}:resample:' || b || ':' || k) AS h FROM t, range({-(-draws // 8)}) r(b)),
u AS (SELECT h.*, b * 8 + i AS draw, ('0x' || substr(h, (8 * i + 1)::INT, 8))::BIGINT AS u FROM h, range(8) x(i) WHERE b * 8 + i < {draws}), w AS (SELECT *, {steps} AS w FROM u)"""


QUERIES = {
    "per_task_cap": (
        per_task_cap,
        f"""WITH {TASKS}, a AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY toxic, n_chars DESC, doc_id) > 1 AS again FROM tasks WHERE quality = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY again, toxic, n_chars DESC, doc_id) AS k FROM a) SELECT source, doc_id FROM b WHERE k <= 4""",
    ),
    "direct_quota": (
        direct_quota,
        f"""WITH {TASKS}, d AS (SELECT doc_id, row_number() OVER (ORDER BY {H("direct")}, doc_id) AS k FROM tasks WHERE n_chars < 1000)
SELECT doc_id FROM tasks WHERE n_chars >= 1000 UNION ALL SELECT doc_id FROM d WHERE k <= floor(0.15::DOUBLE / (1 - 0.15::DOUBLE) * (SELECT count(*) FROM tasks WHERE n_chars >= 1000))""",
    ),
    "language_quota": (
        language_quota,
        f"""WITH {TASKS}, c AS (SELECT count(*) FILTER (WHERE lang = 'en') AS m, count(*) AS n FROM tasks),
d AS (SELECT doc_id, row_number() OVER (ORDER BY {H("language")}, doc_id) AS k FROM tasks WHERE lang <> 'en')
SELECT doc_id FROM tasks WHERE lang = 'en' UNION ALL SELECT doc_id FROM d, c WHERE k <= CASE WHEN m > 0 AND m / n < 0.7 THEN floor(m * (1 - 0.7::DOUBLE) / 0.7::DOUBLE) ELSE n END""",
    ),
    "domain_cap": (
        domain_cap,
        f"""WITH {TASKS}, d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {H("domain")}, doc_id) AS k FROM tasks)
SELECT source, doc_id FROM d WHERE k <= greatest(1, floor(0.04::DOUBLE * (SELECT count(*) FROM tasks)))""",
    ),
    "domain_holdout": (
        domain_holdout,
        f"""WITH {TASKS}, s AS (SELECT source AS domain, count(*) AS n FROM tasks GROUP BY 1)
SELECT domain, n, coalesce(sum(n) OVER (ORDER BY sha256(domain) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < sum(n) OVER () * 0.15::DOUBLE AS held FROM s""",
    ),
    "assign_eval": (
        assign_eval,
        f"""WITH {TASKS}, s AS (SELECT source AS family, count(*) AS n FROM tasks GROUP BY 1)
SELECT family, n, CASE WHEN coalesce(sum(n) OVER (ORDER BY family DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < sum(n) OVER () * 0.2::DOUBLE AND row_number() OVER (ORDER BY family DESC) < count(*) OVER () THEN 'eval' ELSE 'train' END AS split FROM s""",
    ),
    "epoch_schedule": (
        epoch_schedule,
        """WITH e AS (SELECT p_partkey, unnest([0, 1, 2])::INT AS epoch FROM part), o AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY sha256('7:schedule:' || epoch || ':' || p_partkey), p_partkey) - 1 AS place FROM e), n AS (SELECT count(*) AS n FROM part)
SELECT p_partkey, epoch, place, epoch * ceil(n / 16.0)::BIGINT + place // 16 AS batch, epoch * n + place AS dataset_index, epoch * n + place + 7 AS job_seed FROM o, n""",
    ),
    "weighted_replay": (
        weighted_replay,
        """WITH e AS (SELECT c_nationkey AS task_id, o_orderkey AS entry_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1 AS i FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT task_id, count(*) AS n FROM e GROUP BY 1), w AS (SELECT task_id, n, (task_id % 4 + 1)::DOUBLE AS weight FROM t),
c AS (SELECT task_id, n, sum(weight) OVER (ORDER BY task_id) / sum(weight) OVER () AS hi, (sum(weight) OVER (ORDER BY task_id) - weight) / sum(weight) OVER () AS lo, lead(task_id) OVER (ORDER BY task_id) IS NULL AS tail FROM w),
d AS (SELECT range AS draw, ('0x' || substr(sha256('3:task:' || range), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(sha256('3:entry:' || range), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS v FROM range(500))
SELECT draw, c.task_id::BIGINT AS task_id, e.entry_id FROM d JOIN c ON u >= lo AND (u < hi OR tail) JOIN e ON e.task_id = c.task_id AND e.i = floor(v * n)::BIGINT""",
    ),
    "minibatches": (
        minibatches,
        """WITH g AS (SELECT group_id, (row_number() OVER (ORDER BY sha256('1:minibatch:' || group_id), group_id) - 1) // 8 AS minibatch FROM (SELECT DISTINCT o_custkey AS group_id FROM orders))
SELECT group_id, o_orderkey AS episode_id, minibatch FROM g JOIN orders ON o_custkey = group_id""",
    ),
    "bootstrap_ci": (
        bootstrap_ci,
        f"""WITH t AS (SELECT o_custkey AS k, sum(CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5 ELSE 0.0 END) AS s, count(*) AS n FROM orders GROUP BY 1),
{resamples("5", 200)}, m AS (SELECT draw, sum(w * s) / sum(w * n) AS mean FROM w GROUP BY draw), s AS (SELECT list_sort(list(mean)) AS m FROM m)
SELECT round(m[6], 6) AS low, round(m[195], 6) AS high FROM s""",
    ),
    "wilcoxon_z": (
        wilcoxon_z,
        """WITH a AS (SELECT o_custkey AS g, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') / 1000) AS x, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') / 1000) AS y FROM orders GROUP BY 1),
d AS (SELECT y - x AS d FROM a WHERE x IS NOT NULL AND y IS NOT NULL AND abs(y - x) > 1e-12), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d),
t AS (SELECT count(*) AS n, sum(r) FILTER (WHERE d > 0) AS w FROM r)
SELECT n, round(w::DOUBLE, 6) AS w, round((w - n * (n + 1) / 4) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM t""",
    ),
    "grouping_report": (
        grouping_report,
        """WITH r AS (SELECT o_custkey AS g, avg((o_orderstatus = 'F')::INT) AS rate FROM orders GROUP BY 1), j AS (SELECT rate, c_mktsegment AS domain, (c_acctbal > 5000)::INT AS write FROM r JOIN customer ON c_custkey = g)
SELECT domain, coalesce(write, -1) AS write, count(*) AS tasks, round(avg(rate), 6) AS mean_rate, grouping_id(domain, write)::BIGINT AS level FROM j GROUP BY GROUPING SETS ((), (domain), (write))""",
    ),
}
