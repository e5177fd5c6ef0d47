"""Queries on conversation structure, transcripts and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import certify, metrics
from tidewright.sources import tables as T


def dialogue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User replies, agent turns and first questions of conversations."""
    return certify.dialogue_stats(T.messages(spark, sf_dir))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of each conversation's transcript, its middle cut out beyond 1,000 characters."""
    out = certify.transcripts(T.messages(spark, sf_dir), limit=1000)
    return out.select("episode_id", F.length("transcript").cast("long").alias("characters"), F.sha2(F.col("transcript").cast("binary"), 256).alias("digest"))


def selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, languages and size classes of the good documents."""
    rows = T.tasks(spark, sf_dir).where("quality = 1")
    turns = F.floor(F.col("n_chars") / 500).cast("int")
    return certify.selection_report(rows.select(F.col("source").alias("category"), F.col("lang").alias("language"), turns.alias("turns"), turns.alias("replies")))


def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best daily mean of event values so far."""
    days = T.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))
    return metrics.best_so_far(days.withColumn("day", F.date_format("day", "yyyy-MM-dd")), "day", "value")


MESSAGES = "m AS (SELECT conv_id AS episode_id, turn, role, coalesce(text, '') AS t FROM conversations)"

QUERIES = {
    "dialogue_stats": (
        dialogue_stats,
        f"""WITH {MESSAGES} SELECT episode_id, greatest(count(*) FILTER (WHERE role = 'user') - 1, 0) AS user_replies, count(*) FILTER (WHERE role = 'assistant') AS agent_turns,
bool_or(role = 'assistant' AND regexp_matches(t, '[?？]')) AS asks_first FROM m GROUP BY episode_id""",
    ),
    "transcripts": (
        transcripts,
        f"""WITH {MESSAGES}, l AS (SELECT episode_id, turn, role || ': ' || t AS line FROM m WHERE role <> 'system'), j AS (SELECT episode_id, string_agg(line, chr(10) ORDER BY turn) AS t FROM l GROUP BY episode_id),
c AS (SELECT episode_id, CASE WHEN length(t) > 1000 THEN left(t, 500) || chr(10) || '...' || chr(10) || right(t, 500) ELSE t END AS t FROM j)
SELECT episode_id, length(t) AS characters, sha256(t) AS digest FROM c""",
    ),
    "selection_report": (
        selection_report,
        """WITH r AS (SELECT source, lang, (n_chars // 500)::INT AS k FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
SELECT 'category' AS measure, source AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'language', lang, count(*) FROM r GROUP BY 2
UNION ALL SELECT 'turns', CASE WHEN k <= 4 THEN '1-4' WHEN k <= 9 THEN '5-9' ELSE '10+' END, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'user_replies', least(k, 10)::VARCHAR, count(*) FROM r GROUP BY 2""",
    ),
    "best_so_far": (
        best_so_far,
        """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS value FROM events GROUP BY 1),
b AS (SELECT *, max(value) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
SELECT day, value, before IS NULL OR value > before AS improved, greatest(coalesce(before, value), value) AS best FROM b""",
    ),
}
