"""World tables: generators, events, perturbations and approval flips, by deterministic hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.functions.ordering import hash_choice, hash_number, hash_order, hash_uniform
from tidewright.operators.selection import numbered
from tidewright.sources.shared import tasks_for, written

# How far calendar cells move, in minutes.
CALENDAR_SHIFTS = (-4320, -1440, -120, -60, 60, 120, 1440, 4320)


def generated_table(spark: SparkSession, count: int, columns: dict[str, dict], seed: int = 0) -> DataFrame:
    """A table of ``count`` rows from column rules.

    ``sequence`` (start, step, prefix, width), ``cycle`` (values, offset) and ``constant`` (value); others raise.
    """
    rows = spark.range(count)
    out = []
    for name, rule in columns.items():
        kind = rule["kind"]
        if kind == "sequence":
            number = F.lit(rule.get("start", 1)) + F.col("id") * rule.get("step", 1)
            text = F.lpad(number.cast("string"), rule["width"], "0") if rule.get("width") else number.cast("string")
            out.append((F.concat(F.lit(rule["prefix"]), text) if rule.get("prefix") else (text if rule.get("width") else number)).alias(name))
        elif kind == "cycle":
            values = F.array(*[F.lit(v) for v in rule["values"]])
            out.append(F.get(values, F.pmod(F.col("id") + seed + rule.get("offset", 0), F.lit(len(rule["values"]))).cast("int")).alias(name))
        elif kind == "constant":
            out.append(F.lit(rule["value"]).alias(name))
        else:
            raise ValueError(f"unknown generator {kind!r}")
    return rows.select(*out)


def apply_events(rows: DataFrame, events: DataFrame, now: Column | int) -> DataFrame:
    """Rows (table, row_id, cells: map<string,string>) after all events due at ``now``, the last by (at, event id) per cell.

    ``events``: event_id, at, table, row_id, set (map<string,string>).
    """
    due = events.where(F.col("at") <= now).select("table", "row_id", "at", F.col("event_id").cast("string").alias("e"), F.explode("set").alias("column", "value"))
    last = due.groupBy("table", "row_id", "column").agg(F.max_by("value", F.struct("at", "e")).alias("value"))
    changes = last.groupBy("table", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("__c"))
    merged = F.when(F.col("__c").isNull(), F.col("cells")).otherwise(F.map_concat(F.map_filter("cells", lambda k, v: ~F.coalesce(F.map_contains_key("__c", k), F.lit(False))), "__c"))
    return rows.join(changes, ["table", "row_id"], "left").withColumn("cells", merged).drop("__c")


def approval_flips(facts: DataFrame) -> DataFrame:
    """request_id, world and facts (map<string,string>) with each boolean ``approve...`` fact flipped by itself, by key."""
    keys = F.array_sort(F.filter(F.map_keys("facts"), lambda k: k.startswith("approve") & F.element_at("facts", k).isin("true", "false")))
    each = facts.select("request_id", "facts", F.explode(keys).alias("__k"))
    flipped = F.transform_values("facts", lambda k, v: F.when(k == F.col("__k"), F.when(v == "true", "false").otherwise("true")).otherwise(v))
    return each.select("request_id", F.concat(F.lit("flip:"), "__k").alias("world"), flipped.alias("facts"))


def mutable_cells(cells: DataFrame) -> DataFrame:
    """Cells (table, row_id, column, kind, value) that a perturbation may change: booleans, integers and calendar texts, no ids."""
    names = (F.col("column") != "id") & ~F.col("column").endswith("_id") & ~F.col("column").endswith("_ids")
    return cells.where(names & (F.col("kind").isin("boolean", "integer") | ((F.col("kind") == "string") & S.is_calendar(F.col("value")))))


def perturbed(cells: DataFrame, seeds: DataFrame, most: int = 3, peers_shown: int = 64) -> DataFrame:
    """seed, table, row_id, column, old and new: one to ``most`` cells of the world changed for each seed.

    The cells are numbered by hash, and a seed's draws are numbers, so cells and seeds meet in a join of equals. Booleans flip, calendar texts move by a fixed shift (whole days without a
    time), integers become a neighbour within 3, 0 or a value of the column (the ``peers_shown`` least), never themselves
    and never negative.
    """
    can = mutable_cells(cells)
    number = F.col("value").try_cast("long")
    values = can.where("kind = 'integer'").select("table", "column", number.alias("p")).distinct()
    few = values.withColumn("__k", F.row_number().over(Window.partitionBy("table", "column").orderBy("p"))).where(F.col("__k") <= peers_shown)
    peers = few.groupBy("table", "column").agg(F.array_sort(F.collect_list("p")).alias("peers"))
    places = written(numbered(can, hash_order(0, "cell", "table", "row_id", "column"), ["table", "row_id", "column"], "__p"))
    n = F.lit(max(1, places.count()))
    wanted = F.pmod(hash_number(0, "cells", "seed"), F.lit(most)) + 1
    draws = F.array(*[F.pmod(hash_number(0, f"cell{k}", "seed"), n) for k in range(most)])
    picked = seeds.select("seed").distinct().select("seed", F.explode(F.array_distinct(F.slice(draws, F.lit(1), wanted.cast("int")))).alias("__p"))
    rows = picked.join(places, "__p").drop("__p").join(peers, ["table", "column"], "left")
    v = number
    near = F.array(*[F.greatest(F.lit(0).cast("long"), v + d) for d in (-3, -2, -1, 1, 2, 3)], F.lit(0).cast("long"))
    options = F.array_sort(F.filter(F.array_distinct(F.concat(near, F.coalesce("peers", F.expr("array()").cast("array<bigint>")))), lambda x: x != v))
    chosen = F.coalesce(hash_choice(0, "value", options, "seed", "table", "row_id", "column"), v + 1)
    shifts = F.array(*[F.lit(m) for m in CALENDAR_SHIFTS])
    days = F.filter(shifts, lambda m: m % 1440 == 0)
    moved = S.shift(F.col("value"), hash_choice(0, "shift", F.when(F.col("value").contains("T"), shifts).otherwise(days), "seed", "table", "row_id", "column"))
    new = F.when(F.col("kind") == "boolean", F.when(F.col("value") == "true", "false").otherwise("true")).when(F.col("kind") == "integer", chosen.cast("string")).otherwise(moved)
    return rows.select("seed", "table", "row_id", "column", F.col("value").alias("old"), new.alias("new"))


def value_pool(cells: DataFrame, show: int = 50) -> DataFrame:
    """column and up to ``show`` of its least distinct values, with its kind; only these are collected."""
    place = F.row_number().over(Window.partitionBy("column", "kind").orderBy("value"))
    few = cells.select("column", "kind", "value").where("value is not null").distinct().withColumn("__k", place).where(F.col("__k") <= show)
    return few.groupBy("column", "kind").agg(F.array_sort(F.collect_list("value")).alias("values"))


def overlay(rows: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with patches (table, row_id, set) applied to existing rows and columns, and the patches that fit nothing."""
    tasks = tasks_for(rows, patches)
    # One key: a table that is a literal would be folded out of the join, which is then dealt anew to fewer tasks.
    at = F.when(F.col("table").isNotNull() & F.col("row_id").isNotNull(), F.struct("table", "row_id")).alias("__at")
    rows, patches = rows.select("*", at).repartition(tasks, "__at"), patches.select("*", at).repartition(tasks, "__at")
    joined = patches.join(rows.select("__at", "cells"), "__at", "left")
    alien = F.array_except(F.map_keys("set"), F.map_keys("cells"))
    bad = joined.where(F.col("cells").isNull() | (F.size(alien) > 0)).select("table", "row_id", F.when(F.col("cells").isNull(), "no such row").otherwise(F.concat(F.lit("no such column: "), F.array_join(F.array_sort(alien), ", "))).alias("problem"))
    change = patches.select("__at", F.col("set").alias("__s"))
    fixed = F.when(F.col("__s").isNull(), F.col("cells")).otherwise(F.transform_values("cells", lambda k, v: F.coalesce(F.try_element_at("__s", k), v)))
    return rows.join(change, "__at", "left").withColumn("cells", fixed).drop("__s", "__at"), bad


def goal_alternatives(goals: DataFrame, rows: DataFrame, show: int = 3) -> DataFrame:
    """task_id, parameter and other: plausible other values of goal parameters (task_id, parameter, kind, value).

    A boolean is turned round; a number takes its successor and twice itself plus three (1 and 5 for 0); an id takes the
    first ``show`` other ids of its table (``rows``: table, id, place).
    """
    number = F.col("value").try_cast("double")
    plain = F.when(F.col("kind") == "boolean", F.array(F.when(F.col("value") == "true", "false").otherwise("true"))).when(
        F.col("kind") == "number", F.when(number == 0, F.array(F.lit("1"), F.lit("5"))).otherwise(F.array((number + 1).cast("long").cast("string"), (number * 2 + 3).cast("long").cast("string")))
    )
    told = goals.where("kind <> 'string'").select("task_id", "parameter", F.explode(plain).alias("other"))
    first = rows.select("table", "place", F.col("id").alias("other"))
    place = F.row_number().over(Window.partitionBy("table").orderBy("place"))
    first = first.withColumn("__k", place).where(F.col("__k") <= show + 1).drop("__k")
    ids = goals.where("kind = 'string'").join(rows.select("table", F.col("id").alias("value")), "value").join(first, "table").where("other <> value")
    near = F.row_number().over(Window.partitionBy("task_id", "parameter").orderBy("place"))
    return told.unionByName(ids.withColumn("__k", near).where(F.col("__k") <= show).select("task_id", "parameter", "other"))


def task_fields(goals: DataFrame, outcomes: DataFrame) -> DataFrame:
    """task_id, field and description of a task's answer: one field a goal (task_id, place, process), in their order.

    ``outcomes``: process, description. A goal of a process without an outcome has no field.
    """
    named = goals.join(outcomes.select("process", F.coalesce("description", F.lit("")).alias("__d")), "process")
    text = F.trim(F.concat(F.lit("Goal "), "place", F.lit(" ("), "process", F.lit("): "), "__d"))
    return named.select("task_id", F.concat(F.lit("goal_"), "place").alias("field"), text.alias("description"))


def nested_values(rows: DataFrame, id: str, value: str) -> DataFrame:
    """id and value: the texts and whole numbers at any depth of a JSON text, as texts.

    Depth is peeled level by level in Spark; the loop ends with the deepest level.
    """
    level = rows.select(F.col(id).alias("id"), F.try_parse_json(value).alias("v")).where("v is not null")
    out = None
    while not level.isEmpty():
        kind = F.schema_of_variant("v")
        flat = level.withColumn("k", kind)
        leaf = flat.where("k = 'STRING' or k = 'BIGINT'").select("id", F.try_variant_get("v", "$", "string").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        items = flat.where("k like 'ARRAY%'").select("id", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
        fields = flat.where("k like 'OBJECT%'").select("id", F.explode(F.map_values(F.try_variant_get("v", "$", "map<string,variant>"))).alias("v"))
        level = written(items.unionByName(fields))
    return out if out is not None else rows.select(F.col(id).alias("id"), F.lit(None).cast("string").alias("value")).limit(0)


def composed(worlds: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests of tasks (task_id, world_id, title, facts, script) on worlds (world_id, title, rules): the task's title or the world's."""
    of = worlds.select("world_id", F.col("title").alias("__t"), "rules")
    return tasks.join(of, "world_id").select("task_id", "world_id", F.coalesce("title", "__t").alias("title"), "rules", "facts", "script")


def script_elements(tasks: DataFrame, elements: dict[str, float], *, least: int = 1, most: int = 3, identity: float = 0.3, seed: int = 0) -> DataFrame:
    """task_id and elements of the user's script: each by its own draw, at most ``most``; none for direct tasks.

    If fewer than ``least`` are drawn, those of least hash fill up; identity comes with wrong_first and forgotten, or by a draw.
    """
    names = list(elements)
    drawn = F.array_compact(F.array(*[F.when(hash_uniform(seed, f"script-{n}", "task_id") < p, F.lit(n)) for n, p in elements.items()]))
    order = F.array_sort(F.array(*[F.struct(hash_order(seed, f"extra-{n}", "task_id").alias("o"), F.lit(n).alias("n")) for n in names]))["n"]
    chosen = F.slice(drawn, 1, most)
    filled = F.when(F.size(chosen) < least, F.slice(F.array_distinct(F.concat(chosen, order)), 1, least)).otherwise(chosen)
    rows = tasks.withColumn("__e", F.when(F.col("shape") == "direct", F.expr("cast(array() as array<string>)")).otherwise(filled))
    extra = F.arrays_overlap("__e", F.array(F.lit("wrong_first"), F.lit("forgotten"))) | (hash_uniform(seed, "identity", "task_id") < identity)
    return rows.select("task_id", F.when((F.size("__e") > 0) & extra, F.array_append("__e", F.lit("identity"))).otherwise(F.col("__e")).alias("elements"))


def step_counts(trace: DataFrame) -> DataFrame:
    """episode_id, step and n of tool calls and confirmations (kind, tool, key)."""
    step = F.when(F.col("kind") == "confirm", F.concat(F.lit("confirm "), "key")).when(F.col("kind") == "tool", F.col("tool"))
    return trace.withColumn("step", step).where("step is not null").groupBy("episode_id", "step").agg(F.count("*").alias("n"))


def natural_accepted(*, red_flags: Column, natural: Column, equivalent: Column, missing: Column, added: Column, restates: Column) -> Column:
    """Whether a rewritten opening may stand: no flags, natural (4 or more), equivalent, nothing missing or added, no rule restated."""
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) == 0
    return empty(red_flags) & (F.coalesce(natural, F.lit(0)) >= 4) & F.coalesce(equivalent, F.lit(False)) & empty(missing) & empty(added) & ~F.coalesce(restates, F.lit(True))
