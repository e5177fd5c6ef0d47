"""Queries on advantages, weights and diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import rl
from tidewright.operators import credit, metrics
from tidewright.sources import tables as T

EPISODES = """episodes AS (SELECT o_custkey AS group_id, o_orderkey AS episode_id, o_orderdate AS arrival, o_orderpriority AS priority,
  CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.5 ELSE 0.0 END AS reward, o_orderstatus <> 'P' AS terminated FROM orders)"""
STEP = ["line", "part", "supplier", "price", "day"]
LINES = """lines AS (SELECT l_orderkey AS episode_id, l_quantity AS tokens, -l_discount AS old_logp, -l_tax AS new_logp, l_tax AS value,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS step FROM lineitem)"""


def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = credit.group_advantages(T.episodes(spark, sf_dir), "group_id", "reward")
    return rows.select("group_id", "episode_id", F.round("advantage", 6).alias("advantage"))


def task_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread of each customer's last 64 rewards, one group per order."""
    rows = T.episodes(spark, sf_dir).withColumn("task", F.col("group_id"))
    out = credit.task_scale(rows, "task", "episode_id", ["arrival", "episode_id"], "reward")
    return out.select("task", "episode_id", F.round("scale", 6).alias("scale"))


def gae_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised advantages of each order's lines (gamma 0.99, lambda 0.95), the reward on the last line."""
    rows = T.actions(spark, sf_dir)
    order = [*STEP, "tokens", "old_logp", "value"]
    rows = rows.withColumn("step", F.row_number().over(Window.partitionBy("episode_id").orderBy(*STEP, "tokens", F.desc("old_logp"), "value")))
    final = T.episodes(spark, sf_dir).select("episode_id", F.col("reward").alias("final"), "terminated")
    rows = credit.terminal_reward(rows.join(final, "episode_id"), "episode_id", "step", "final")
    last = F.col("reward") > 0
    out = credit.episode_gae(rows.drop(*order[:5]), "episode_id", ["step"], reward=F.col("reward"), value=F.col("value"), terminated=last, bootstrap=F.lit(0.1), gamma=0.99, lam=0.95)
    flat = out.select("episode_id", F.inline(F.arrays_zip(F.transform("steps", lambda s: s["step"]).alias("step"), F.col("advantages").alias("advantage"), F.col("returns").alias("ret"))))
    return flat.select("episode_id", "step", F.round("advantage", 6).alias("advantage"), F.round("ret", 6).alias("ret"))


def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and token weights of the lines of each customer's orders, summed per order."""
    rows = T.actions(spark, sf_dir).join(T.episodes(spark, sf_dir).select("group_id", "episode_id"), "episode_id")
    out = None
    for kind in ("sequence", "token"):
        w = credit.sample_weights(rows, "group_id", "episode_id", F.col("tokens"), aggregation=kind)
        part = w.groupBy("group_id", "episode_id").agg(F.round(F.sum("weight"), 8).alias(f"{kind}_weight"))
        out = part if out is None else out.join(part, ["group_id", "episode_id"])
    return out


def importance_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.actions(spark, sf_dir).groupBy("episode_id").agg(F.collect_list(F.struct("new_logp", "old_logp")).alias("p"))
    d = rl.importance_diagnostics(F.col("p.new_logp"), F.col("p.old_logp"), 0.02)
    rows = rows.select("episode_id", d.alias("d")).select("episode_id", "d.*")
    return rows.select("episode_id", *[F.round(c, 6).alias(c) for c in ("effective_sample_fraction", "max_abs_log_ratio", "importance_clip_fraction")])


def clipped_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped surrogate, sampled divergence and value loss per order."""
    a = T.actions(spark, sf_dir)
    adv = F.col("tokens") / 25.0 - 1
    rows = a.select(
        "episode_id",
        rl.clipped_surrogate(F.col("new_logp"), F.col("old_logp"), adv, 0.02).alias("s"),
        rl.sampled_kl(F.col("new_logp"), F.col("old_logp")).alias("k"),
        rl.clipped_value_loss(F.col("value"), -F.col("old_logp"), F.lit(0.05), 0.02).alias("v"),
    )
    return rows.groupBy("episode_id").agg(F.round(F.sum("s"), 6).alias("surrogate"), F.round(F.avg("k"), 6).alias("kl"), F.round(F.sum("v"), 6).alias("value_loss"))


def low_prob_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of an order stay under a probability of 0.95, all if none would."""
    rows = T.actions(spark, sf_dir).groupBy("episode_id").agg(F.collect_list("old_logp").alias("p"))
    mask = rl.low_probability_mask(F.col("p"), F.transform("p", lambda _: F.lit(1)), 0.95)
    return rows.select("episode_id", F.size("p").cast("long").alias("n"), F.aggregate(mask, F.lit(0), lambda s, x: s + x).cast("long").alias("trained"))


def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.episodes(spark, sf_dir).withColumns(
        {"truncated": F.lit(None).cast("boolean"), "context_limit": F.col("priority") == "1-URGENT", "actions": F.pmod("episode_id", F.lit(7)) + 1, "tokens": F.pmod("episode_id", F.lit(97)),
         "tool_calls": F.pmod("episode_id", F.lit(5)), "token_limited": F.pmod("episode_id", F.lit(2)), "protocol_errors": F.pmod("episode_id", F.lit(3))}
    )
    out = metrics.group_metrics(rows, "group_id")
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: F.round(c, 6) for c in doubles})


def eval_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.episodes(spark, sf_dir).join(T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("split")), "group_id")
    out = metrics.evaluation(rows, "group_id", "split")
    return out.select(F.coalesce("group_id", F.lit(-1).cast("long")).alias("group_id"), "split", "episodes", F.round("mean_reward", 6).alias("mean_reward"), F.round("success_rate", 6).alias("success_rate"), "level")


def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.episodes(spark, sf_dir).withColumn("won", F.col("reward") >= 1 - 1e-9)
    out = metrics.pass_at_k(rows, "group_id", "won", played=F.col("priority") != "5-LOW")
    return out.select("group_id", "played", "successes", F.round("rate", 6).alias("rate"), F.round("variance", 6).alias("variance"), "status")


QUERIES = {
    "group_advantages": (
        group_advantages,
        f"""WITH {EPISODES}, s AS (SELECT group_id, avg(reward) AS m, stddev_pop(reward) AS d, count(*) AS n FROM episodes GROUP BY group_id)
SELECT e.group_id, episode_id, round(CASE WHEN n >= 2 THEN (reward - m) / (d + 1e-8) ELSE 0.0 END, 6) AS advantage FROM episodes e JOIN s USING (group_id)""",
    ),
    "task_scale": (
        task_scale,
        f"""WITH {EPISODES} SELECT group_id AS task, episode_id, round(CASE WHEN count(*) OVER w >= 8 THEN stddev_pop(reward) OVER w END, 6) AS scale
FROM episodes WINDOW w AS (PARTITION BY group_id ORDER BY arrival, episode_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)""",
    ),
    "gae_actions": (
        gae_actions,
        f"""WITH RECURSIVE {EPISODES}, {LINES}, held AS (
  SELECT l.episode_id, step, value, CASE WHEN step = count(*) OVER (PARTITION BY l.episode_id) THEN reward ELSE 0.0 END AS r, count(*) OVER (PARTITION BY l.episode_id) AS n
  FROM lines l JOIN episodes e USING (episode_id)
), walk AS (
  SELECT episode_id, step, value, r + CASE WHEN r > 0 THEN 0.0 ELSE 0.99 * 0.1 END - value AS a FROM held WHERE step = n
  UNION ALL
  SELECT h.episode_id, h.step, h.value, h.r + CASE WHEN h.r > 0 THEN 0.0 ELSE 0.99 * w.value END - h.value + CASE WHEN h.r > 0 THEN 0.0 ELSE 0.99 * 0.95 * w.a END
  FROM walk w JOIN held h ON h.episode_id = w.episode_id AND h.step = w.step - 1
) SELECT episode_id, step::INT AS step, round(a, 6) AS advantage, round(a + value, 6) AS ret FROM walk""",
    ),
    "sample_weights": (
        sample_weights,
        f"""WITH {EPISODES}, a AS (SELECT group_id, e.episode_id, l_quantity AS t FROM lineitem JOIN episodes e ON e.episode_id = l_orderkey),
s AS (SELECT group_id, episode_id, sum(t) AS e FROM a GROUP BY ALL), g AS (SELECT group_id, sum(e) AS g, count(*) AS n FROM s GROUP BY ALL)
SELECT a.group_id, a.episode_id, round(sum(t / (e * greatest(1, n))), 8) AS sequence_weight, round(sum(t / greatest(1, g)), 8) AS token_weight
FROM a JOIN s ON s.group_id = a.group_id AND s.episode_id = a.episode_id JOIN g ON g.group_id = a.group_id GROUP BY a.group_id, a.episode_id""",
    ),
    "importance_diagnostics": (
        importance_diagnostics,
        f"""WITH {LINES}, d AS (SELECT episode_id, new_logp - old_logp AS d, max(new_logp - old_logp) OVER (PARTITION BY episode_id) AS m FROM lines)
SELECT episode_id, round(pow(sum(exp(d - m)), 2) / sum(pow(exp(d - m), 2)) / count(*), 6) AS effective_sample_fraction, round(max(abs(d)), 6) AS max_abs_log_ratio,
round(avg(CASE WHEN d < {math.log1p(-0.02)!r} OR d > {math.log1p(0.02)!r} THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS importance_clip_fraction FROM d GROUP BY episode_id""",
    ),
    "clipped_objective": (
        clipped_objective,
        f"""WITH {LINES}, t AS (SELECT episode_id, exp(new_logp - old_logp) AS r, tokens / 25.0 - 1 AS a, old_logp - new_logp AS k, value, -old_logp AS ov FROM lines),
u AS (SELECT *, ov + greatest(least(value - ov, 0.02), -0.02) AS c FROM t)
SELECT episode_id, round(sum(-least(r * a, greatest(least(r, 1.02), 0.98) * a)), 6) AS surrogate, round(avg(exp(k) - k - 1), 6) AS kl,
round(sum(0.5 * greatest((value - 0.05) * (value - 0.05), (c - 0.05) * (c - 0.05))), 6) AS value_loss FROM u GROUP BY episode_id""",
    ),
    "low_prob_mask": (
        low_prob_mask,
        f"""WITH {LINES}, c AS (SELECT episode_id, count(*) AS n, count(*) FILTER (WHERE exp(old_logp) < 0.95) AS k FROM lines GROUP BY episode_id)
SELECT episode_id, n, CASE WHEN k > 0 THEN k ELSE n END AS trained FROM c""",
    ),
    "group_metrics": (
        group_metrics,
        f"""WITH {EPISODES}, e AS (SELECT *, terminated AND reward >= 1 - 1e-9 AS won, priority = '1-URGENT' AS cl, episode_id % 7 + 1 AS actions, episode_id % 97 AS tokens,
  episode_id % 5 AS tc, episode_id % 2 AS tl, episode_id % 3 AS pe FROM episodes)
SELECT group_id, count(*) AS episodes, count(*) FILTER (WHERE won) AS reward_successes, round(1 - avg(won::INT), 6) AS reward_non_success_rate, bool_and(won) AS all_success_group,
bool_and(reward <= 0) AS all_failure_group, count(*) >= 2 AS grpo_group_eligible, count(*) >= 2 AND max(reward) - min(reward) < 1e-12 AS grpo_zero_advantage_group,
count(*) FILTER (WHERE reward >= 1 - 1e-9 AND NOT terminated) AS high_reward_unterminated, round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std,
min(reward) AS reward_min, max(reward) AS reward_max, max(reward) - min(reward) AS reward_range, max(reward) = min(reward) AS zero_reward_variance,
CASE WHEN max(reward) <> min(reward) THEN NULL WHEN bool_and(won) THEN 'all_success' WHEN bool_and(reward <= 0) THEN 'all_failure' ELSE 'equal_reward' END AS zero_variance_kind,
round(avg(won::INT), 6) AS success_rate, round(avg(terminated::INT), 6) AS termination_rate, round(avg((NOT terminated)::INT), 6) AS truncation_rate, round(avg(cl::INT), 6) AS context_limit_rate,
round(avg(actions), 6) AS actions_mean, sum(tokens)::BIGINT AS generated_tokens, round(avg(tokens), 6) AS tokens_per_episode, sum(tc)::BIGINT AS tool_calls, sum(pe)::BIGINT AS protocol_errors,
round(sum(tl) / greatest(sum(actions), 1), 6) AS token_limit_rate FROM e GROUP BY group_id""",
    ),
    "eval_by_split": (
        eval_by_split,
        f"""WITH {EPISODES}, j AS (SELECT group_id, c_mktsegment AS split, reward, (terminated AND reward >= 1 - 1e-9)::INT AS won FROM episodes JOIN customer ON c_custkey = group_id)
SELECT coalesce(group_id, -1) AS group_id, split, count(*) AS episodes, round(avg(reward), 6) AS mean_reward, round(avg(won), 6) AS success_rate, grouping_id(group_id, split)::BIGINT AS level
FROM j GROUP BY GROUPING SETS ((group_id), (split), ())""",
    ),
    "pass_at_k": (
        pass_at_k,
        f"""WITH {EPISODES}, h AS (SELECT group_id, CASE WHEN priority <> '5-LOW' THEN (reward >= 1 - 1e-9)::INT END AS hit FROM episodes)
SELECT group_id, count(hit) AS played, coalesce(sum(hit), 0)::BIGINT AS successes, round(avg(hit), 6) AS rate, round(var_pop(hit), 6) AS variance,
CASE WHEN count(hit) = 0 THEN 'unplayed' WHEN sum(hit) > 0 THEN 'passed' ELSE 'unsolved' END AS status FROM h GROUP BY group_id""",
    ),
}
