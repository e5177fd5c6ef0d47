"""Certification of worlds and tools, transcripts, conversation structure and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S

# Arguments that make a tool a table reader.
TABLE_ARGUMENTS = ("table", "table_name", "tables", "collection")


def tool_problems(tools: DataFrame, tables: list[str]) -> DataFrame:
    """tool and problem of tools (name, write, arguments: array of name and type) that read tables whole or write objects."""
    names = F.transform("arguments", lambda a: a["name"])
    generic = F.regexp_like("name", F.lit("(read|get|list|dump|query|fetch)_(table|rows|records)$")) | F.col("name").isin([f"{v}_{t}" for v in ("read", "dump") for t in tables])
    reader = F.arrays_overlap(names, F.array(*[F.lit(a) for a in TABLE_ARGUMENTS])) | generic
    objects = F.filter("arguments", lambda a: F.col("write") & a["type"].startswith("dict"))
    texts = F.concat(
        F.when(reader, F.array(F.lit("a generic table reader"))).otherwise(F.expr("cast(array() as array<string>)")),
        F.transform(objects, lambda a: F.concat(F.lit("argument "), a["name"], F.lit(" is an object"))),
    )
    return tools.select(F.col("name").alias("tool"), F.explode(texts).alias("problem"))


def policy_leaks(policies: DataFrame) -> DataFrame:
    """policy_id and leaks: identifiers, table and tool names (array ``names``) and private facts that a policy text shows."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[a-z]+_[a-z_]+\b"), F.lit(0)))
    named = F.filter("names", lambda n: F.regexp_like("text", F.concat(F.lit(r"\b"), n, F.lit(r"\b"))))
    told = F.filter("facts", lambda f: (F.length(f) >= 3) & F.contains(F.col("text"), f))
    return policies.select("policy_id", F.array_sort(F.array_distinct(F.concat(ids, named, told))).alias("leaks"))


def transcripts(messages: DataFrame, limit: int = 12_000, result_limit: int = 400) -> DataFrame:
    """episode_id and transcript: turns in order, tool results cut, the middle cut out beyond ``limit`` characters."""
    body = F.when(F.col("role") == "tool", F.concat(F.lit("result: "), F.substring("content", 1, result_limit))).otherwise(F.concat_ws(": ", "role", "content"))
    lines = messages.where("role <> 'system'").select("episode_id", F.struct("msg_idx", body.alias("line")).alias("x"))
    joined = lines.groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_list("x"))["line"], "\n").alias("t"))
    return joined.select("episode_id", S.middle_cut(F.col("t"), limit).alias("transcript"))


def parsed_reply(text: Column, *, think: tuple[str, str] = ("<think>", "</think>"), call: tuple[str, str] = ("<tool_call>", "</tool_call>")) -> Column:
    """reasoning, content, calls (JSON texts) and error of a model's reply: what is missing, left over or empty is named."""
    body = F.ltrim(text)
    thinks = body.startswith(think[0])
    inner = F.substring(body, F.lit(len(think[0]) + 1), F.length(body))
    reasoning = F.when(thinks, F.trim(F.substring_index(inner, think[1], 1)))
    rest = F.when(thinks, F.substring(inner, F.instr(inner, think[1]) + len(think[1]), F.length(inner))).otherwise(body)
    pieces = F.split(rest, F.lit(f"\\Q{call[0]}\\E"))
    content, tails = F.trim(F.get(pieces, 0)), F.slice(pieces, F.lit(2), F.size(pieces))
    calls = F.transform(tails, lambda t: F.trim(F.substring_index(t, call[1], 1)))
    closed = F.forall(tails, lambda t: t.contains(call[1]))
    clean = F.forall(tails, lambda t: F.trim(F.substring(t, F.instr(t, call[1]) + len(call[1]), F.length(t))) == "")
    sound = F.forall(calls, lambda c: F.coalesce(F.length(F.try_variant_get(F.try_parse_json(c), "$.name", "string")) > 0, F.lit(False)))
    error = (
        F.when(thinks & ~inner.contains(think[1]), "incomplete reasoning block")
        .when(~closed, "incomplete tool call")
        .when(~clean, "unexpected text after tool call")
        .when(~sound, "tool call requires a function name")
        .when((F.size(calls) == 0) & rest.contains(call[1]), "unexpected tool call end")
        .when((F.size(calls) == 0) & (content == ""), "empty assistant response")
    )
    return F.struct(reasoning.alias("reasoning"), content.alias("content"), calls.alias("calls"), error.alias("error"))


def dialogue_stats(messages: DataFrame) -> DataFrame:
    """episode_id, user_replies (without the opening), agent_turns and asks_first (a question before the first call)."""
    order = Window.partitionBy("episode_id").orderBy("msg_idx")
    called = F.max(F.when((F.col("role") == "assistant") & (F.col("n_calls") > 0), 1).otherwise(0)).over(order)
    asks = (F.col("role") == "assistant") & (F.col("n_calls") == 0) & F.regexp_like("content", F.lit("[?？]"))
    rows = messages.withColumn("__a", asks & (called == 0))
    users, agents = F.count(F.when(F.col("role") == "user", 1)), F.count(F.when(F.col("role") == "assistant", 1))
    return rows.groupBy("episode_id").agg(F.greatest(users - 1, F.lit(0)).alias("user_replies"), agents.alias("agent_turns"), F.bool_or("__a").alias("asks_first"))


def dialogue_report(stats: DataFrame, lines: dict[str, float]) -> DataFrame:
    """Medians and shares of dialogue statistics, and passed: none under its line."""
    out = stats.agg(F.count("*").alias("episodes"), F.median("user_replies").alias("user_replies"), F.median("agent_turns").alias("agent_turns"), F.bround(F.avg(F.col("asks_first").cast("int")), 3).alias("asks_first"))
    ok = F.lit(True)
    for name, line in lines.items():
        ok = ok & F.coalesce(F.col(name) >= line, F.lit(True))
    return out.withColumn("passed", ok)


def tool_health(simulations: DataFrame) -> DataFrame:
    """calls_per_sim, no_call_sims, announce_without_call and write_attempted over simulations (calls: names; texts; needs_write)."""
    n = F.greatest(F.count("*"), F.lit(1))
    tried = F.exists("calls", S.is_write) | F.exists("calls", lambda c: c.startswith("transfer"))
    wanted = F.greatest(F.count(F.when(F.col("needs_write"), 1)), F.lit(1))
    said = F.size(F.filter("texts", lambda t: F.regexp_like(t, F.lit(S.ANNOUNCE))))
    return simulations.agg(
        F.bround(F.sum(F.size("calls")) / n, 1).alias("calls_per_sim"),
        F.bround(F.count(F.when(F.size("calls") == 0, 1)) / n, 3).alias("no_call_sims"),
        F.bround(F.sum(said) / n, 2).alias("announce_without_call"),
        F.bround(F.count(F.when(F.col("needs_write") & tried, 1)) / wanted, 3).alias("write_attempted"),
    )


def selection_report(selected: DataFrame) -> DataFrame:
    """measure, value and n over selected episodes (category, language, turns, replies): counts in one pass of grouping sets."""
    turns = F.when(F.col("turns") <= 4, "1-4").when(F.col("turns") <= 9, "5-9").otherwise("10+")
    rows = selected.select(F.inline(F.array(
        F.struct(F.lit("category").alias("measure"), F.col("category").alias("value")),
        F.struct(F.lit("language").alias("measure"), F.col("language").alias("value")),
        F.struct(F.lit("turns").alias("measure"), turns.alias("value")),
        F.struct(F.lit("user_replies").alias("measure"), F.least("replies", F.lit(10)).cast("string").alias("value")),
    )))
    return rows.groupBy("measure", "value").agg(F.count("*").alias("n"))


def field_gaps(predictions: DataFrame) -> DataFrame:
    """task_id, field and best of the fields that none of the k predictions got wholly right."""
    return predictions.groupBy("task_id", "field").agg(F.max("score").alias("best")).where("best < 1")


def usage(events: DataFrame) -> DataFrame:
    """session, input and output tokens, and its errors, of event-log records (session, kind, input, output, message, number)."""
    errors = F.array_sort(F.collect_list(F.when(F.col("kind") == "error", F.struct("number", "message"))))
    return events.groupBy("session").agg(F.coalesce(F.sum("input"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output"), F.lit(0)).alias("output_tokens"), errors["message"].alias("errors"))


def goal_signature(goals: Column) -> Column:
    """A text that tasks share if their goals (process, params: map of texts) differ only in the later digits of numbers."""

    def bucket(v: Column) -> Column:
        x = v.try_cast("double")
        size = F.pow(F.lit(10.0), F.length(F.floor(F.abs(x)).cast("string")) - 1)
        return F.when(x.isNull(), v).otherwise(F.when(x == 0, "0").otherwise((F.bround(x / size) * size).cast("long").cast("string")))

    one = lambda g: F.concat_ws("|", g["process"], F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(g["params"], lambda k, v: bucket(v)))))))
    return F.array_join(F.array_sort(F.transform(goals, one)), ";")


def state_shape(rows: DataFrame) -> DataFrame:
    """table and the distinct column sets of its rows (cells: map)."""
    return rows.groupBy("table").agg(F.array_sort(F.collect_set(F.array_join(F.array_sort(F.map_keys("cells")), ","))).alias("shapes"))


def masked_created(rows: DataFrame, initial: DataFrame, mask: str = "<new>", references: dict[str, str] | None = None) -> DataFrame:
    """Rows with the ids of rows that the initial state lacks replaced by one mask, in their own and other cells.

    An id is new in its own table only. Cells of the columns in ``references`` (column to foreign table), and the id cell,
    are masked by that table's new ids; other cells by ids that are new somewhere and that no initial table has.
    """
    made = rows.join(initial.select("table", "row_id"), ["table", "row_id"], "left_anti").select("table", "row_id").distinct()
    nowhere = made.select("row_id").distinct().join(initial.select("row_id"), "row_id", "left_anti").select(F.lit("").alias("of"), F.col("row_id").alias("value"))
    known = made.select(F.col("table").alias("of"), F.col("row_id").alias("value")).unionByName(nowhere).withColumn("new", F.lit(True))
    foreign = F.create_map(*[F.lit(x) for pair in (references or {"": ""}).items() for x in pair])
    cells = rows.select("table", "row_id", F.explode("cells").alias("column", "value"))
    cells = cells.withColumn("of", F.when(F.col("column") == "id", F.col("table")).otherwise(F.coalesce(F.try_element_at(foreign, F.col("column")), F.lit(""))))
    marked = cells.join(known, ["of", "value"], "left")
    back = marked.groupBy("table", "row_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", F.when(F.col("new"), F.lit(mask)).otherwise(F.col("value")).alias("value"))))).alias("cells"))
    return back.join(made.withColumn("new", F.lit(True)), ["table", "row_id"], "left").select("table", F.when(F.col("new"), F.lit(mask)).otherwise(F.col("row_id")).alias("row_id"), "cells")


def unrepaired(original: DataFrame, repaired: DataFrame, skipped: DataFrame, refused: DataFrame) -> DataFrame:
    """Skipped steps (task_id, step) that occur less often after repair than before, refused writes discounted by one."""
    count = lambda d, name: d.groupBy("task_id", "step").agg(F.count("*").alias(name))
    rows = skipped.select("task_id", "step").distinct().join(count(original, "a"), ["task_id", "step"], "left").join(count(repaired, "b"), ["task_id", "step"], "left").join(refused.select("task_id", "step", F.lit(1).alias("r")).distinct(), ["task_id", "step"], "left")
    zero = F.lit(0)
    return rows.where(F.coalesce("b", zero) < F.coalesce("a", zero) - F.coalesce("r", zero)).select("task_id", "step")


def audit_problems(verdicts: DataFrame, found: DataFrame, legal: list[str], free: str = "consistent") -> DataFrame:
    """task_id, item and problem of audit rows (verdict, quote, request): illegal, without a verbatim quote, or missing."""
    quote = (F.col("verdict") == free) | S.quoted(F.col("quote"), F.col("request"))
    bad = verdicts.select("task_id", "item", F.when(~F.coalesce(F.col("verdict").isin(*legal), F.lit(False)), "illegal verdict").when(~quote, "no verbatim quote").alias("problem")).where("problem is not null")
    gaps = found.join(verdicts.select("task_id", "item"), ["task_id", "item"], "left_anti").select("task_id", "item", F.lit("not covered").alias("problem"))
    return bad.unionByName(gaps)


def missing_approvals(confirmed: DataFrame, facts: DataFrame) -> DataFrame:
    """task_id and the sorted keys that were confirmed without a fact to decide them."""
    gone = confirmed.join(facts.select("task_id", "key").distinct(), ["task_id", "key"], "left_anti")
    return gone.groupBy("task_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def qualification(gates: DataFrame) -> DataFrame:
    """task_id, qualified and the sorted failed gates."""
    return gates.groupBy("task_id").agg(F.bool_and("passed").alias("qualified"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))).alias("failed"))


def world_status(*, excluded: Column, valid: Column, verifier_ok: Column, env_ok: Column, same: Column) -> Column:
    return F.when(excluded, "excluded").when(~valid, "invalid").when(~verifier_ok, "verifier_error").when(~env_ok, "env_error").when(same, "agree").otherwise("mismatch")


def category_fits(category: Column, shape: Column) -> Column:
    """Whether a trace's shape may carry a declared category."""
    return F.when(category == "direct_response", shape == "direct").when(category == "simple_agentic", shape == "simple").otherwise(shape.isin("ordinary", "single_write", "complex"))


def step_monitor(messages: DataFrame) -> DataFrame:
    """Per assistant message the tool results, tool errors (status 400 and above) and protocol errors since the one before."""
    order = Window.partitionBy("episode_id").orderBy("msg_idx")
    step = F.count(F.when(F.col("role") == "assistant", 1)).over(order)
    tool = F.col("role") == "tool"
    return messages.withColumn("step", step).groupBy("episode_id", "step").agg(
        F.count(F.when(tool, 1)).alias("tool_results"), F.count(F.when(tool & (F.col("status") >= 400), 1)).alias("tool_errors"), F.count(F.when(F.col("role") == "protocol_error", 1)).alias("protocol_errors")
    )


def findings(reports: DataFrame) -> DataFrame:
    """report_id and its open findings as a list in markdown."""
    lines = F.array_sort(F.collect_list(F.when(~F.coalesce("closed", F.lit(False)), F.struct("number", F.concat(F.lit("- "), "text").alias("line")))))
    return reports.groupBy("report_id").agg(F.array_join(lines["line"], "\n").alias("markdown"))
