"""Queries on credit over trees, replay, batches, checkpoints, metrics and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import credit, episodes, grading, metrics, selection, statistics
from tidewright.sources import tables as T
from tidewright.sources.shared import tasks_for


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tree groups: the first order of a status is its trunk, the later ones branch off it at step 1 to 3."""
    e = T.episodes(spark, sf_dir)
    tree = Window.partitionBy("group_id", "terminated").orderBy("arrival", "episode_id")
    rows = e.withColumn("k", F.row_number().over(tree)).withColumn("trunk", F.first("episode_id").over(tree))
    return rows.select(
        "group_id", "episode_id", F.when(F.col("k") == 1, "trunk").otherwise("branch").alias("role"), F.when(F.col("k") > 1, F.col("trunk")).alias("trunk"),
        F.when(F.col("k") > 1, (F.col("k") % 3 + 1).cast("int")).alias("fork_step"), (F.col("price") / 1e5).alias("reward"), F.lit(4).alias("n_actions"), (F.col("episode_id") % 9 != 0).alias("trainable"),
    )


def _actions(out: DataFrame) -> DataFrame:
    return out.select("group_id", "episode_id", F.posexplode("advantages").alias("action", "advantage")).select("group_id", "episode_id", "action", F.round("advantage", 6).alias("advantage"))


def tree_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-action credit of trees by segments between forks."""
    return _actions(credit.tree_advantages(_trees(spark, sf_dir)))


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-action credit of trees by the trajectories through an action."""
    return _actions(credit.tree_advantages(_trees(spark, sf_dir), mode="tree_grpo"))


def fork_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four best fork points of each customer: lines by price, one per order first."""
    actions, held = T.actions(spark, sf_dir), T.episodes(spark, sf_dir).select("episode_id", "group_id")
    tasks = tasks_for(actions)
    a = actions.repartition(tasks, "episode_id").groupBy("episode_id", "line").agg(F.max("price").alias("score"))
    rows = a.join(held.repartition(tasks, "episode_id"), "episode_id").select("group_id", F.col("episode_id").alias("trunk"), F.col("line").alias("step"), "score")
    return credit.choose_forks(rows.repartition(tasks, "group_id"), 4).select("group_id", "trunk", "step", "place")


def terminal_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order's price on its last line, nothing on the others."""
    actions, held = T.actions(spark, sf_dir), T.episodes(spark, sf_dir).select("episode_id", "price")
    tasks = tasks_for(actions)
    a = actions.repartition(tasks, "episode_id").groupBy("episode_id", "line").agg(F.count("*").alias("n")).join(held.repartition(tasks, "episode_id"), "episode_id")
    return credit.terminal_reward(a, "episode_id", "line", "price").select("episode_id", "line", F.round("reward", 2).alias("reward"))


def prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the schedule of the customers may be read ahead of batch 3."""
    tasks = T.table(spark, sf_dir, "customer").select("c_custkey")
    return selection.prefetch_limit(selection.epoch_schedule(tasks, "c_custkey", epochs=2, batch=16), 3)


def eligible_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that may be replayed: few lines so far, not too old."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), (F.col("o_orderkey") % 5).alias("uses"), (F.col("o_orderkey") % 40).alias("age_origin"))
    return selection.eligible_replay(o, 30, max_uses=3, max_age=10)


def kept_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as checkpoints: the pointer and the newest stay."""
    s = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("version"), (F.col("s_suppkey") == 3).alias("is_pointer"))
    return selection.prune_checkpoints(s, 5).where("kept").select("version")


def old_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as snapshots: the old ones can go, but the protected."""
    return selection.prune_snapshots(T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("version")), 9, 3, [2, 4])


def physical_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation packed by the length of their balance."""
    rows = T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("bucket"), F.col("c_custkey").alias("sample_id"), (F.abs("c_acctbal") / 100).cast("long").alias("length"))
    return selection.fits(rows, 6, 300)


def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest open order of each customer, the least number on ties."""
    o = T.table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return selection.first_per(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums over the nations' customers."""
    c = T.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("balance"), F.max("c_acctbal").alias("most"))
    total = F.sum("n").over(Window.partitionBy())
    out = metrics.weighted_metrics(c.withColumn("weight", F.col("n") / total), "weight", ["balance", "most"])
    return out.select(F.round("balance", 4).alias("balance"), F.round("most", 4).alias("most"), "total_weight_ok")


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as seconds of routes."""
    route = F.when(F.col("event_type") == "view", "/v1/tools/find").when(F.col("event_type") == "click", "/v1/chat/completions").when(F.col("event_type") == "signup", "/v1/restore").when(F.col("event_type") == "purchase", "close")
    out = metrics.stage_times(T.table(spark, sf_dir, "events").select(route.alias("route"), F.col("value").alias("seconds")))
    return out.select("kind", F.round("seconds", 2).alias("seconds"), "calls")


def differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as worlds of a differential run."""
    k = F.col("o_orderkey")
    status = F.when(k % 97 == 0, "invalid").when(k % 89 == 0, "excluded").when((k % 83 == 0) & (k > 1000), "mismatch").otherwise("agree")
    return metrics.differential(T.table(spark, sf_dir, "orders").select(k.alias("world"), status.alias("status"), (k % 2 == 0).alias("perturbed")), 100)


def constant_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by customer and priority where three or more orders agree."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field"), F.col("o_orderpriority").alias("property"), F.col("o_orderstatus").alias("value"))
    return metrics.constant_leaves(o)


def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending orders by priority, with the first three."""
    o = T.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderpriority", F.col("o_orderkey").alias("example"))
    out = metrics.disagreements(o, ["o_orderpriority"], 3)
    return out.select("o_orderpriority", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def outcome_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials, success rate and success of all, by customer."""
    o = T.table(spark, sf_dir, "orders").withColumn("success", F.col("o_orderstatus") != "P")
    return statistics.outcome_rates(o, ["o_custkey"], "success").select("o_custkey", "trials", F.round("rate", 6).alias("rate"), "pass_all")


def stop_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that all lines of an order show where none is finished."""
    lines = T.table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("task_id"), (F.col("l_linestatus") == "F").alias("success"), F.lit(True).alias("state_ok"), F.array("l_returnflag", F.when(F.col("l_discount") < 0.05, "cheap").otherwise(F.col("l_returnflag"))).alias("failed_fields"))
    return episodes.stop_fields(rows).select("task_id", F.array_join("fields", ",").alias("fields"))


def behaviour_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of metrics over the orders' features."""
    k = F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select(
        (F.col("o_orderstatus") == "F").alias("success"), (k % 4 / 4.0).alias("reward"), (k % 3).alias("repeats"), (k % 7 % 2).alias("unknown"), (F.col("o_orderstatus") != "P").alias("terminated"), (k % 5).alias("calls"),
        (k % 2 == 0).alias("asked_first"), (k % 6).alias("widest"), (k % 4).alias("id_arguments"), (k % 4 % 2).alias("ungrounded"), F.when(k % 8 == 3, 1).otherwise(0).alias("copied"),
    )
    return episodes.behaviour_metrics(rows)


def best_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best line of each order among its accepted outcomes."""
    rows = T.actions(spark, sf_dir).groupBy("episode_id", F.col("line").alias("outcome")).agg(F.max("price").alias("reward"), F.max((F.col("tokens") > 25).cast("int")).alias("s"))
    return grading.best_outcome(rows.withColumn("success", F.col("s") == 1).drop("s"), ["episode_id"]).select("episode_id", "outcome", "success", F.round("reward", 2).alias("reward"))


def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as criteria of an order's rubric: the score, its gate and the reward."""
    rows = T.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") % 3).alias("level"), (F.col("l_linenumber") % 5 + 1).alias("weight"), (F.col("l_returnflag") == "R").alias("gate"))
    out = grading.rubric_score(rows, "l_orderkey")
    graded = grading.rubric_reward(F.col("score"), F.col("gate"), F.col("l_orderkey") % 10 != 0, F.col("l_orderkey") % 9, F.lit(1))
    return out.select("l_orderkey", F.round("score", 6).alias("score"), "gate", graded["success"].alias("success"), F.floor(graded["reward"] * 100 + 0.001).alias("reward_cents"))


TREES = """w AS (SELECT o_custkey AS g, o_orderkey AS e, o_totalprice / 1e5 AS r, o_orderkey % 9 <> 0 AS k, o_orderstatus <> 'P' AS t, row_number() OVER o AS n, first_value(o_orderkey) OVER o AS tree FROM orders WINDOW o AS (PARTITION BY o_custkey, o_orderstatus <> 'P' ORDER BY o_orderdate, o_orderkey)),
x AS (SELECT g, e, tree, n = 1 AS trunk, CASE WHEN n > 1 THEN n % 3 + 1 END AS f, r, k FROM w),
gs AS (SELECT g, stddev_pop(r) FILTER (WHERE k) AS s, avg(r) FILTER (WHERE k) AS al, coalesce(avg(r) FILTER (WHERE k AND trunk), avg(r) FILTER (WHERE k)) AS root FROM x GROUP BY 1),
ts AS (SELECT g, tree, avg(r) FILTER (WHERE k) AS mean, max(r) FILTER (WHERE k AND trunk) AS tr FROM x GROUP BY 1, 2),
y AS (SELECT x.*, s, root, tr, (r - mean) + (r - al) AS leaf FROM x JOIN gs USING (g) JOIN ts USING (g, tree)),
fs AS (SELECT g, tree, f, (coalesce(sum(r) FILTER (WHERE k), 0) + coalesce(any_value(tr), 0)) / nullif(count(*) FILTER (WHERE k) + (any_value(tr) IS NOT NULL)::INT, 0) AS v, count(*) FILTER (WHERE k) AS n, coalesce(sum(leaf) FILTER (WHERE k), 0) AS leaves FROM y WHERE NOT trunk GROUP BY 1, 2, 3),
a AS (SELECT y.*, j::INT AS j FROM y, range(4) t(j))"""

QUERIES = {
    "tree_segments": (
        tree_segments,
        f"""WITH {TREES}, p AS (SELECT a.*, fs.v AS own, coalesce((SELECT max_by(v, q.f) FROM fs q WHERE q.g = a.g AND q.tree = a.tree AND q.f <= a.j AND v IS NOT NULL AND q.f = (SELECT max(z.f) FROM fs z WHERE z.g = a.g AND z.tree = a.tree AND z.f <= a.j)), root) AS b,
coalesce((SELECT min_by(v, q.f) FROM fs q WHERE q.g = a.g AND q.tree = a.tree AND q.f > a.j AND v IS NOT NULL AND q.f = (SELECT min(z.f) FROM fs z WHERE z.g = a.g AND z.tree = a.tree AND z.f > a.j)), r) AS n FROM a LEFT JOIN fs ON fs.g = a.g AND fs.tree = a.tree AND fs.f = a.f)
SELECT g AS group_id, e AS episode_id, j AS action, round(CASE WHEN k AND s >= 1e-8 THEN CASE WHEN trunk THEN (n - b) + (n - root) ELSE (r - own) + (r - root) END / s ELSE 0 END, 6) AS advantage FROM p""",
    ),
    "tree_paths": (
        tree_paths,
        f"""WITH {TREES}, p AS (SELECT a.g, a.e, a.j, any_value(a.k) AS k, any_value(a.s) AS s, any_value(a.trunk) AS trunk, any_value(a.leaf) AS leaf, coalesce(sum(fs.leaves), 0) AS more, coalesce(sum(fs.n), 0) AS n FROM a LEFT JOIN fs ON a.trunk AND fs.g = a.g AND fs.tree = a.tree AND fs.f > a.j GROUP BY 1, 2, 3)
SELECT g AS group_id, e AS episode_id, j AS action, round(CASE WHEN k AND s >= 1e-8 THEN CASE WHEN trunk THEN (leaf + more) / (1 + n) ELSE leaf END / s ELSE 0 END, 6) AS advantage FROM p""",
    ),
    "fork_points": (
        fork_points,
        """WITH l AS (SELECT o_custkey AS group_id, l_orderkey AS trunk, l_linenumber AS step, max(l_extendedprice) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY group_id, trunk ORDER BY score DESC, step) > 1 AS again FROM l), p AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY again, score DESC, trunk, step) AS place FROM b)
SELECT group_id, trunk, step, place FROM p WHERE place <= 4""",
    ),
    "terminal_rewards": (
        terminal_rewards,
        """WITH l AS (SELECT DISTINCT l_orderkey AS episode_id, l_linenumber AS line, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem)
SELECT episode_id, line, CASE WHEN line = last THEN round(o_totalprice, 2) ELSE 0.0 END AS reward FROM l JOIN orders ON o_orderkey = episode_id""",
    ),
    "prefetch": (prefetch, 'SELECT least(5 * 16, (SELECT count(*) FROM customer)) AS "limit"'),
    "eligible_replay": (eligible_replay, "SELECT o_orderkey AS entry_id, o_orderkey % 5 AS uses, o_orderkey % 40 AS age_origin FROM orders WHERE o_orderkey % 5 < 3 AND 30 - o_orderkey % 40 BETWEEN 0 AND 10"),
    "kept_checkpoints": (kept_checkpoints, "SELECT s_suppkey AS version FROM supplier ORDER BY s_suppkey = 3 DESC, s_suppkey DESC LIMIT 5"),
    "old_snapshots": (old_snapshots, "SELECT s_suppkey AS version FROM supplier WHERE s_suppkey < 7 AND s_suppkey NOT IN (0, 2, 4)"),
    "physical_batches": (
        physical_batches,
        """WITH RECURSIVE c AS (SELECT c_nationkey::BIGINT AS bucket, c_custkey AS sample_id, trunc(abs(c_acctbal) / 100)::BIGINT AS length, row_number() OVER (PARTITION BY c_nationkey ORDER BY trunc(abs(c_acctbal) / 100), c_custkey) AS k FROM customer),
w AS (SELECT bucket, sample_id, k, 0::BIGINT AS batch, 1::BIGINT AS n FROM c WHERE k = 1 UNION ALL
SELECT c.bucket, c.sample_id, c.k, w.batch + (n + 1 > 6 OR length * (n + 1) > 300)::INT, CASE WHEN n + 1 > 6 OR length * (n + 1) > 300 THEN 1 ELSE n + 1 END FROM w JOIN c ON c.bucket = w.bucket AND c.k = w.k + 1)
SELECT bucket, sample_id, batch FROM w""",
    ),
    "near_misses": (
        near_misses,
        "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey, o_orderkey FROM o WHERE k = 1",
    ),
    "weighted_metrics": (
        weighted_metrics,
        """WITH c AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS b, max(c_acctbal) AS m FROM customer GROUP BY 1)
SELECT round(sum(n * b) / sum(n), 4) AS balance, round(sum(n * m) / sum(n), 4) AS most, true AS total_weight_ok FROM c""",
    ),
    "stage_times": (
        stage_times,
        """SELECT CASE event_type WHEN 'view' THEN 'tool' WHEN 'click' THEN 'chat' WHEN 'signup' THEN 'restore' WHEN 'purchase' THEN 'close' ELSE 'other' END AS kind, round(sum(value), 2) AS seconds, count(*) AS calls FROM events GROUP BY 1""",
    ),
    "differential": (
        differential,
        """WITH w AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'invalid' WHEN o_orderkey % 89 = 0 THEN 'excluded' WHEN o_orderkey % 83 = 0 AND o_orderkey > 1000 THEN 'mismatch' ELSE 'agree' END AS s, o_orderkey % 2 = 0 AS p FROM orders)
SELECT count(*) FILTER (WHERE s = 'agree') AS agree, count(*) FILTER (WHERE s = 'mismatch') AS mismatch, 0 AS verifier_error, 0 AS env_error, count(*) FILTER (WHERE s = 'invalid') AS invalid, count(*) FILTER (WHERE s = 'excluded') AS excluded,
count(*) FILTER (WHERE s = 'mismatch') = 0 AND bool_and(p OR s = 'agree') AND count(*) FILTER (WHERE s = 'agree') >= 105 AS passed FROM w""",
    ),
    "constant_leaves": (
        constant_leaves,
        "SELECT o_custkey AS field, o_orderpriority AS property, count(*) AS answers, min(o_orderstatus) AS value FROM orders GROUP BY 1, 2 HAVING count(*) >= 3 AND min(o_orderstatus) = max(o_orderstatus)",
    ),
    "disagreements": (
        disagreements,
        "SELECT o_orderpriority, count(*) AS n, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS examples FROM orders WHERE o_orderstatus = 'P' GROUP BY 1",
    ),
    "outcome_rates": (outcome_rates, "SELECT o_custkey, count(*) AS trials, round(avg((o_orderstatus <> 'P')::INT), 6) AS rate, bool_and(o_orderstatus <> 'P') AS pass_all FROM orders GROUP BY 1"),
    "stop_fields": (
        stop_fields,
        """WITH l AS (SELECT l_orderkey AS t, l_returnflag AS flag, CASE WHEN l_discount < 0.05 THEN 'cheap' ELSE l_returnflag END AS other, l_linestatus = 'F' AS won FROM lineitem), n AS (SELECT t, count(*) AS n, bool_or(won) AS won FROM l GROUP BY 1),
f AS (SELECT t, flag AS field FROM l UNION ALL SELECT t, other FROM l WHERE other <> flag), c AS (SELECT t, field, count(*) AS k FROM f GROUP BY 1, 2)
SELECT t AS task_id, string_agg(field, ',' ORDER BY field) AS fields FROM c JOIN n USING (t) WHERE k = n AND NOT won GROUP BY 1""",
    ),
    "behaviour_metrics": (
        behaviour_metrics,
        """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)
SELECT count(*) AS episodes, round_even(avg((s = 'F')::INT), 3) AS success, round_even(avg(k % 4 / 4.0), 3) AS mean_reward, round_even(avg((k % 3 > 0)::INT), 3) AS repeat_failures, round_even(avg((k % 7 % 2 > 0)::INT), 3) AS unknown_tools,
round_even(avg((s = 'P')::INT), 3) AS step_limit, round_even(count(*) FILTER (WHERE k % 2 = 0 AND k % 5 > 0) / count(*) FILTER (WHERE k % 5 > 0), 3) AS asks_before_lookup, round_even(avg((k % 6 > 3)::INT), 3) AS wide_turns,
round_even(sum(k % 4 % 2) / sum(k % 4), 3) AS ungrounded_ids, round_even(count(*) FILTER (WHERE k % 8 = 3) / sum(k % 4), 3) AS example_copies FROM o""",
    ),
    "best_outcomes": (
        best_outcomes,
        """WITH l AS (SELECT l_orderkey AS episode_id, l_linenumber AS outcome, max(l_extendedprice) AS reward, bool_or(l_quantity > 25) AS success FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY success DESC, reward DESC, outcome) AS k FROM l)
SELECT episode_id, outcome, success, round(reward, 2) AS reward FROM r WHERE k = 1""",
    ),
    "rubric_scores": (
        rubric_scores,
        """WITH r AS (SELECT l_orderkey, sum((l_linenumber % 5 + 1) * (l_quantity % 3) / 2) / sum(l_linenumber % 5 + 1) AS score, NOT bool_or(l_returnflag = 'R' AND l_quantity % 3 = 0) AS gate, l_orderkey % 9 AS calls FROM lineitem GROUP BY 1),
c AS (SELECT *, CASE WHEN gate AND l_orderkey % 10 <> 0 THEN score ELSE 0 END AS counted, CASE WHEN calls <= 4 THEN 1.0 ELSE greatest(0, (8 - calls) / 4.0) END AS e FROM r)
SELECT l_orderkey, round(score, 6) AS score, gate, counted >= 0.8 AS success, floor(100 * (0.95 * counted + CASE WHEN counted >= 0.8 THEN 0.05 * e ELSE 0 END) + 0.001)::BIGINT AS reward_cents FROM c""",
    ),
}
