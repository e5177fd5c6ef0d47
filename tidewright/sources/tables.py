"""The driver tables, and adapters that read them as the library's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: a user is an episode, an event type a tool, props the arguments; errors fail, purchases write."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("episode_id"),
        F.col("event_id").alias("msg_idx"),
        F.lit(0).alias("call_idx"),
        F.col("event_type").alias("name"),
        F.col("props").alias("arguments"),
        (F.col("event_type") == "error").alias("failed"),
        (F.col("event_type") == "purchase").alias("write"),
        "ts",
        "value",
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes: a customer is a group, the status gives reward and end."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("group_id"),
        F.col("o_orderkey").alias("episode_id"),
        F.when(status == "F", 1.0).when(status == "O", 0.5).otherwise(0.0).alias("reward"),
        (status != "P").alias("terminated"),
        F.col("o_orderdate").alias("arrival"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as actions: an order is an episode, the quantity its tokens, the discount a log-probability, the tax a value."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("episode_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").alias("day"),
        F.col("l_quantity").alias("tokens"),
        (-F.col("l_discount")).alias("old_logp"),
        (-F.col("l_tax")).alias("new_logp"),
        F.col("l_tax").alias("value"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages without tool calls."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode_id"),
        F.col("turn").alias("msg_idx"),
        "role",
        F.coalesce("text", F.lit("")).alias("content"),
        F.lit(0).alias("n_calls"),
        F.lit(None).cast("string").alias("call_id"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as selected episodes: the source is a domain, quality the success, toxicity a violation."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(labels, "doc_id")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a user's episode: views are calls, clicks words, errors and purchases results, signups the user.

    An error is told in one of two ways, every third word is a question; ``number`` is the event's property.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    text = (
        F.when((kind == "error") & (k % 2 == 0), F.concat(F.lit("Error: "), k))
        .when(kind == "error", F.concat(F.lit('{"ok": false, "error": "'), k, F.lit('"}')))
        .when(kind == "purchase", F.concat(F.lit('{"ok": true, "result": "'), k, F.lit('"}')))
        .when((kind == "click") & (k % 3 == 0), F.concat(F.lit("Is it "), k, F.lit("?")))
        .when(kind == "click", F.concat(F.lit("It is "), k))
        .when(kind == "view", "")
        .otherwise(k.cast("string"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("episode_id"),
        F.col("event_id").alias("msg_idx"),
        F.when(kind.isin("view", "click"), "assistant").when(kind == "signup", "user").otherwise("tool").alias("role"),
        text.alias("content"),
        F.when(kind == "view", 1).otherwise(0).alias("n_calls"),
        F.when(~kind.isin("view", "click", "signup"), F.concat(F.lit("c"), k)).alias("call_id"),
        k.alias("number"),
    )
