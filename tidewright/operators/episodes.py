"""Episode analytics over exploded messages and calls.

``messages``: episode_id, msg_idx, role, content, n_calls (tool calls of the message), call_id (of a tool result).
``calls``: episode_id, msg_idx, call_idx, call_id, name, arguments (JSON text), failed, write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S

CALL_ORDER = ["msg_idx", "call_idx"]


def explode_messages(episodes: DataFrame, id: str = "episode_id") -> tuple[DataFrame, DataFrame]:
    """Messages and calls of nested episodes (``messages``: array of role, content, tool_calls, tool_call_id)."""
    rows = episodes.select(F.col(id).alias("episode_id"), F.posexplode("messages").alias("msg_idx", "m"))
    messages = rows.select("episode_id", "msg_idx", "m.role", F.coalesce("m.content", F.lit("")).alias("content"), F.coalesce(F.size("m.tool_calls"), F.lit(0)).alias("n_calls"), F.col("m.tool_call_id").alias("call_id"))
    calls = rows.select("episode_id", "msg_idx", F.posexplode("m.tool_calls").alias("call_idx", "c"))
    calls = calls.select("episode_id", "msg_idx", "call_idx", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.coalesce("c.arguments", F.lit("{}")).alias("arguments"))
    return messages, calls


def calls_with_results(calls: DataFrame, messages: DataFrame) -> DataFrame:
    """Each call with its result text: the last tool message that names it, '' if none."""
    results = messages.where("role = 'tool'").groupBy("episode_id", "call_id").agg(F.max_by("content", "msg_idx").alias("result"))
    return calls.join(results, ["episode_id", "call_id"], "left").withColumn("result", F.coalesce("result", F.lit("")))


def repeated_failures(calls: DataFrame) -> DataFrame:
    """Adds ``repeats``: the call equals (name, arguments) the call right before it, which failed."""
    order = Window.partitionBy("episode_id").orderBy(*CALL_ORDER)
    same = (F.lag("name").over(order) == F.col("name")) & (F.lag("arguments").over(order) == F.col("arguments"))
    return calls.withColumn("repeats", F.coalesce(same & F.lag("failed").over(order), F.lit(False)))


def redundant_turns(calls: DataFrame) -> DataFrame:
    """episode_id, msg_idx, redundant: every call of the turn was made in an earlier turn since the last successful write."""
    turn = Window.partitionBy("episode_id").orderBy("msg_idx").rangeBetween(Window.unboundedPreceding, -1)
    wrote = F.when(F.col("write") & ~F.col("failed"), 1).otherwise(0)
    epochs = calls.withColumn("__e", F.coalesce(F.sum(wrote).over(turn), F.lit(0)))
    first = F.min("msg_idx").over(Window.partitionBy("episode_id", "__e", "name", "arguments"))
    return epochs.withColumn("__seen", first < F.col("msg_idx")).groupBy("episode_id", "msg_idx").agg(F.bool_and("__seen").alias("redundant"))


def failed_turns(messages: DataFrame) -> DataFrame:
    """episode_id and msg_idx of assistant turns that own a failed result: the last assistant turn before it."""
    order = Window.partitionBy("episode_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("role") == "assistant", F.col("msg_idx")), ignorenulls=True).over(order)
    held = messages.withColumn("__o", owner).where((F.col("role") == "tool") & S.is_failure(F.col("content")) & F.col("__o").isNotNull())
    return held.select("episode_id", F.col("__o").alias("msg_idx")).distinct()


def last_words_before(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Each write call with ``asked``: whether the last text-only assistant message before it holds a question mark."""
    text_only = (F.col("role") == "assistant") & (F.col("n_calls") == 0) & (F.trim("content") != "")
    order = Window.partitionBy("episode_id").orderBy("msg_idx").rowsBetween(Window.unboundedPreceding, -1)
    words = messages.select("episode_id", "msg_idx", F.last(F.when(text_only, F.col("content")), ignorenulls=True).over(order).alias("__w"))
    asked = F.coalesce(F.regexp_like("__w", F.lit("[?？]")), F.lit(False))
    return calls.where("write").join(words, ["episode_id", "msg_idx"]).withColumn("asked", asked).drop("__w")


def recoveries(messages: DataFrame) -> DataFrame:
    """episode_id, recovered: after some failed result a later one succeeded, or one of the next two messages asked."""
    order = Window.partitionBy("episode_id").orderBy("msg_idx")
    failure = S.is_failure(F.col("content"))
    good = ((F.col("role") == "tool") & ~failure).cast("int")
    asks = ((F.col("role") == "assistant") & (F.col("n_calls") == 0) & F.regexp_like("content", F.lit("[?？]"))).cast("int")
    later = F.max(good).over(order.rowsBetween(1, Window.unboundedFollowing))
    soon = F.max(asks).over(order.rowsBetween(1, 2))
    hit = (F.col("role") == "tool") & failure & (F.coalesce(F.greatest(later, soon), F.lit(0)) == 1)
    return messages.withColumn("__h", hit).groupBy("episode_id").agg(F.bool_or("__h").alias("recovered"))


def call_profile(messages: DataFrame, calls: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """episode_id, lookups, unused, invented.

    ``calls`` carries result, failed and write. A lookup (neither a write nor failed) is unused if no value of its result
    is in what the assistant says or calls later; an id argument with a digit is invented if it is in no earlier message
    of another role and not in the episode's tool list (``described``: episode_id, tools text).
    """
    said = F.concat_ws(" ", "content", F.col("calls_text"))
    made = calls.groupBy("episode_id", "msg_idx").agg(F.array_join(F.array_sort(F.collect_list(F.struct("call_idx", F.concat_ws(" ", "name", "arguments").alias("t"))))["t"], " ").alias("calls_text"))
    lines = messages.join(made, ["episode_id", "msg_idx"], "left").select("episode_id", F.struct("msg_idx", (F.col("role") == "assistant").alias("own"), F.coalesce(said, F.lit("")).alias("line")).alias("x"))
    # An episode is one row: its lines and its calls, each held once.
    held = lines.groupBy("episode_id").agg(F.collect_list("x").alias("lines"))
    rows = calls.groupBy("episode_id").agg(F.collect_list(F.struct("msg_idx", "arguments", "result", (~F.col("write") & ~F.col("failed")).alias("lookup"))).alias("calls")).join(held, "episode_id")
    rows = rows.join(described, "episode_id", "left") if described is not None else rows.withColumn("tools", F.lit(""))

    def seen(c: Column, v: Column) -> Column:
        return F.exists("lines", lambda x: ~x["own"] & (x["msg_idx"] < c["msg_idx"]) & F.contains(x["line"], v))

    def unused(c: Column) -> Column:
        tokens = F.filter(F.array_distinct(F.regexp_extract_all(c["result"], F.lit(S.TOKEN), 0)), lambda t: ~F.contains(c["arguments"], t) & ~F.regexp_like(t, F.lit("^[A-Za-z]+$")))
        later = lambda t: F.exists("lines", lambda x: x["own"] & (x["msg_idx"] > c["msg_idx"]) & F.contains(x["line"], t))
        return c["lookup"] & (F.size(tokens) > 0) & ~F.exists(tokens, later)

    def invented(c: Column) -> Column:
        pairs = F.map_entries(F.coalesce(F.from_json(c["arguments"], "map<string,string>"), F.expr("map()").cast("map<string,string>")))
        guess = lambda e: F.regexp_like(e["key"], F.lit(S.ID_KEY)) & F.regexp_like(e["value"], F.lit("[0-9]")) & ~seen(c, e["value"]) & ~F.contains(F.coalesce("tools", F.lit("")), e["value"])
        return F.size(F.filter(pairs, guess))

    count = lambda test: F.size(F.filter("calls", test)).cast("long")
    return rows.select("episode_id", count(lambda c: c["lookup"]).alias("lookups"), count(unused).alias("unused"), F.aggregate(F.transform("calls", invented), F.lit(0).cast("long"), lambda a, n: a + n).alias("invented"))


def behaviour_metrics(features: DataFrame) -> DataFrame:
    """One row of rounded metrics over episode features.

    ``features``: success, reward, repeats, unknown (calls to unknown tools), terminated, calls, asked_first, widest,
    id_arguments, ungrounded, copied; one row per episode that has messages.
    """
    n = F.greatest(F.count("*"), F.lit(1))
    ids = F.greatest(F.coalesce(F.sum("id_arguments"), F.lit(0)), F.lit(1))
    called = F.greatest(F.count(F.when(F.col("calls") > 0, 1)), F.lit(1))
    rate = lambda c, d: F.bround(F.coalesce(F.sum(c.cast("double")), F.lit(0.0)) / d, 3)
    return features.agg(
        F.count("*").alias("episodes"),
        rate(F.coalesce("success", F.lit(False)).cast("int"), n).alias("success"),
        rate(F.coalesce("reward", F.lit(0.0)), n).alias("mean_reward"),
        rate((F.col("repeats") > 0).cast("int"), n).alias("repeat_failures"),
        rate((F.col("unknown") > 0).cast("int"), n).alias("unknown_tools"),
        rate((~F.coalesce("terminated", F.lit(True))).cast("int"), n).alias("step_limit"),
        rate((F.col("asked_first") & (F.col("calls") > 0)).cast("int"), called).alias("asks_before_lookup"),
        rate((F.col("widest") > 3).cast("int"), n).alias("wide_turns"),
        rate(F.col("ungrounded"), ids).alias("ungrounded_ids"),
        rate(F.col("copied"), ids).alias("example_copies"),
    )


def reply_flags(messages: DataFrame, language: Column | str = "en") -> DataFrame:
    """Per episode the flags read from its replies (non-blank assistant texts without calls).

    report, announce, repeat (two equal replies over 40 characters in a row), leak and language.
    """
    reply = (F.col("role") == "assistant") & (F.col("n_calls") == 0) & (F.trim("content") != "")
    rows = messages.where(reply)
    order = Window.partitionBy("episode_id").orderBy("msg_idx")
    rows = rows.withColumn("__again", (F.lag("content").over(order) == F.col("content")) & (F.length("content") > 40))
    cjk = F.sum(F.regexp_count("content", F.lit("[一-鿿]"))) / F.greatest(F.sum(F.length("content")), F.lit(1))
    spoken = F.lit(language) if isinstance(language, str) else language
    return rows.groupBy("episode_id").agg(
        F.bool_or(S.is_report(F.col("content"))).alias("report"),
        F.bool_or(F.regexp_like("content", F.lit(S.ANNOUNCE))).alias("announce"),
        F.bool_or(F.coalesce("__again", F.lit(False))).alias("repeat"),
        F.bool_or(S.leaks_internals(F.col("content"))).alias("leak"),
        F.when(spoken == "en", cjk > 0.1).otherwise(cjk < 0.05).alias("language"),
    )


def flag_names(flags: DataFrame, names: list[str]) -> DataFrame:
    """episode_id and the sorted names of its true flags."""
    return flags.select("episode_id", F.array_sort(F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]))).alias("flags"))


def signature(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """episode_id and key: the tool names in order, and the last assistant words in lower case, 160 characters at most."""
    names = calls.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct(*CALL_ORDER, "name")))["name"].alias("__n"))
    said = messages.where("role = 'assistant' and content <> ''").groupBy("episode_id").agg(F.max_by("content", "msg_idx").alias("__w"))
    rows = messages.select("episode_id").distinct().join(names, "episode_id", "left").join(said, "episode_id", "left")
    words = F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce("__w", F.lit(""))), r"\s+", " ")), 1, 160)
    return rows.select("episode_id", F.concat_ws("\n", F.array_join(F.coalesce("__n", F.expr("array()").cast("array<string>")), ","), words).alias("key"))


def rolling_breaker(flags: DataFrame, order: list[str], flag: str, *, window: int = 40, limit: float = 0.25, by: list[str] | None = None) -> DataFrame:
    """Adds rate (of the last ``window`` rows) and tripped (the window is full and the rate above the limit)."""
    frame = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(-(window - 1), 0)
    rows = flags.withColumn("rate", F.avg(F.col(flag).cast("int")).over(frame)).withColumn("__n", F.count("*").over(frame))
    return rows.withColumn("tripped", (F.col("__n") == window) & (F.col("rate") > limit)).drop("__n")


def stop_fields(rows: DataFrame) -> DataFrame:
    """task_id and fields: what every pilot of the task failed, where all failed with the right state.

    ``rows``: task_id, success, state_ok, failed_fields (array of names).
    """
    held = rows.groupBy("task_id").agg(
        F.count("*").alias("n"), F.bool_or(F.coalesce("success", F.lit(False))).alias("won"), F.bool_and(F.coalesce("state_ok", F.lit(False))).alias("state")
    )
    each = rows.select("task_id", F.explode(F.array_distinct("failed_fields")).alias("field")).groupBy("task_id", "field").agg(F.count("*").alias("k"))
    common = each.join(held, "task_id").where("k = n and not won and state")
    return common.groupBy("task_id").agg(F.array_sort(F.collect_list("field")).alias("fields"))


def idle_closure(turns: DataFrame, warn: int = 3) -> DataFrame:
    """Adds run (speech turns in a row since the last tool, proposal or record), warned and closed."""
    order = Window.partitionBy("episode_id").orderBy("seq")
    reset = F.when(F.col("kind") != "chat", 1).otherwise(0)
    runs = turns.withColumn("__r", F.sum(reset).over(order))
    run = F.sum(F.when(F.col("kind") == "chat", 1).otherwise(0)).over(Window.partitionBy("episode_id", "__r").orderBy("seq"))
    return runs.withColumn("run", run).withColumn("warned", F.col("run") == warn).withColumn("closed", F.col("run") > warn).drop("__r")


def training_examples(episodes: DataFrame) -> DataFrame:
    """One row per assistant turn: episode_id, turn and the messages up to it."""
    at = F.filter(F.sequence(F.lit(1), F.size("messages")), lambda i: F.element_at("messages", i)["role"] == "assistant")
    rows = episodes.where(F.size("messages") > 0).select("episode_id", "messages", F.explode(at).alias("turn"))
    return rows.select("episode_id", "turn", F.slice("messages", F.lit(1), F.col("turn")).alias("messages"))
