"""Plans and manifests of tasks on worlds: which processes a task has, which tasks are trained on, which perturbations tell nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.ordering import hash_number, hash_order, hash_uniform
from tidewright.operators.ordered import places

# The shares of shapes after the probes, and the shares of second processes.
WORLD_MIX = {"direct": 0.1, "simple": 0.15, "ordinary": 0.1, "single_write": 0.25, "complex": 0.3, "subjective": 0.1}
SECOND = 0.3
POOLS = {"direct": "inquiry", "subjective": "advice", "single_write": "writer", "complex": "writer", "simple": "reader", "ordinary": "reader"}


def process_pools(processes: DataFrame) -> DataFrame:
    """world, pool and names: the processes (world, process, kind, approval) of a world by what they serve, sorted.

    Inquiries and advice by kind; the rest, or all where there is no rest, are accounts, of which those with an approval write and
    the others read. A pool that would be empty is all accounts; ``inquiries`` and ``advisers`` are those of the kind alone.
    """
    rows = processes.select("world", "process", F.coalesce("kind", F.lit("")).alias("kind"), F.col("approval").isNotNull().alias("writes"))
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("process"))))
    account = ~F.col("kind").isin("inquiry", "advice")
    held = rows.groupBy("world").agg(
        F.array_sort(F.collect_list("process")).alias("all"), names(F.col("kind") == "inquiry").alias("inquiry"), names(F.col("kind") == "advice").alias("advice"), names(account).alias("account"),
        names(F.col("writes")).alias("writing"), names(~F.col("writes")).alias("reading"),
    )
    held = held.withColumn("account", F.when(F.size("account") > 0, F.col("account")).otherwise(F.col("all")))
    within = lambda c: F.array_intersect("account", c)
    or_accounts = lambda c: F.when(F.size(c) > 0, c).otherwise(F.col("account"))
    return held.select("world", "all", or_accounts(F.col("inquiry")).alias("inquiry"), or_accounts(F.col("advice")).alias("advice"), or_accounts(within("writing")).alias("writer"), or_accounts(within("reading")).alias("reader"), F.col("inquiry").alias("inquiries"), F.col("advice").alias("advisers"))


def task_plan(processes: DataFrame, counts: DataFrame, mix: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """world, place, shape and processes of the tasks of each world (``counts``: world, tasks).

    The first tasks are probes, one of each process in order: direct for an inquiry, subjective for advice, else of no shape. The
    others have shapes by rounded shares of the rest, the last filled with single writes, in a hash order. A task's process is that
    of its place in the shape's pool, round and round; three in ten of those that are not direct have a second one of the pool.
    """
    mix = WORLD_MIX if mix is None else mix
    rows = process_pools(processes).join(counts, "world")
    probes = F.least(F.col("tasks").cast("int"), F.size("all"))
    rows = rows.withColumn("__probes", probes).withColumn("__rest", F.col("tasks").cast("int") - probes)
    shares = F.concat(*[F.array_repeat(F.lit(s), F.bround(F.col("__rest") * F.lit(share)).cast("int")) for s, share in mix.items()], F.array_repeat(F.lit("single_write"), F.col("__rest")))
    rows = rows.withColumn("__shapes", F.slice(shares, F.lit(1), F.col("__rest")))
    rest = rows.select("world", "__probes", F.posexplode("__shapes").alias("__k", "shape"))
    order = Window.partitionBy("world").orderBy(hash_order(seed, "plan", "world", "__k"), "__k")  # a world's tasks
    rest = rest.select("world", "shape", (F.col("__probes") + F.row_number().over(order) - 1).alias("place"))
    probe = rows.select("world", F.posexplode(F.slice("all", F.lit(1), F.col("__probes"))).alias("place", "process"), "inquiries", "advisers")
    kind = F.when(F.array_contains("inquiries", F.col("process")), "direct").when(F.array_contains("advisers", F.col("process")), "subjective")
    first = probe.select("world", "place", kind.alias("shape"), F.array("process").alias("processes"))
    pools = rows.select("world", F.map_from_arrays(F.array(*[F.lit(p) for p in ("inquiry", "advice", "writer", "reader")]), F.array("inquiry", "advice", "writer", "reader")).alias("__pools"))
    pool = F.try_element_at("__pools", F.try_element_at(F.create_map(*[F.lit(x) for pair in POOLS.items() for x in pair]), F.col("shape")))
    drawn = rest.join(pools, "world").withColumn("__pool", pool).withColumn("__n", F.size("__pool"))
    at = lambda k: F.get("__pool", F.pmod(k, F.col("__n")).cast("int"))
    two = (F.col("shape") != "direct") & (F.col("__n") > 1) & (hash_uniform(seed, "second", "world", "place") < SECOND)
    other = F.col("place") + 1 + F.pmod(hash_number(seed, "other", "world", "place"), F.greatest(F.col("__n") - 1, F.lit(1)))
    chosen = F.when(two, F.array(at(F.col("place")), at(other))).otherwise(F.array(at(F.col("place"))))
    return first.unionByName(drawn.select("world", "place", "shape", chosen.alias("processes")))


def task_manifest(tasks: DataFrame, worlds: DataFrame, images: DataFrame | None = None, policies: DataFrame | None = None, eval_worlds: int = 0) -> DataFrame:
    """task_id, split and reason: train or eval of the tasks that can be trained on, and why the others cannot.

    ``tasks``: task_id (``<world id>-t<number>``), passed, stage, problems (text). ``worlds``: world, id (null: the world), ready; the last
    ``eval_worlds`` ready ones by name are held for eval. ``images``: world, error, if images are asked for. ``policies``: task_id,
    verdict. Of several reasons the first counts: gates, image, policy.
    """
    ready = places(worlds.where("ready").select("world").distinct(), [F.desc("world")], name="__last")
    held = ready.where(F.col("__last") < eval_worlds).select("world", F.lit("eval").alias("__eval"))
    key = worlds.select(F.coalesce("id", "world").alias("__id"), "world").dropDuplicates(["__id"])
    rows = tasks.withColumn("__id", F.regexp_replace("task_id", r"-t(?!.*-t).*$", "")).join(key, "__id", "left").join(held, "world", "left")
    gate = F.when(~F.coalesce("passed", F.lit(False)), F.substring(F.concat_ws(": ", F.coalesce("stage", F.lit("None")), F.coalesce("problems", F.lit("None"))), 1, 200))
    image = verdict = F.lit(None).cast("string")
    if images is not None:
        rows = rows.join(images.select("world", F.lit(True).alias("__image"), F.col("error").alias("__error")), "world", "left")
        image = F.when(F.col("__image").isNull() | F.col("__error").isNotNull(), "no verified image")
    if policies is not None:
        rows = rows.join(policies.select("task_id", F.col("verdict").alias("__verdict")), "task_id", "left")
        verdict = F.when(F.coalesce(F.col("__verdict") != "passed", F.lit(False)), F.concat(F.lit("policy gate "), "__verdict"))
    rows = rows.withColumn("reason", F.coalesce(gate, image, verdict))
    return rows.select("task_id", F.when(F.col("reason").isNull(), F.coalesce("__eval", F.lit("train"))).alias("split"), "reason")


def insensitive_worlds(cells: DataFrame, runs: DataFrame, excluded: DataFrame, limit: int) -> DataFrame:
    """task_id, place, world and weight of perturbed worlds that change what a task touches and nothing that it does.

    ``cells``: task_id, world, original, perturbed (texts), kind, touched. ``runs``: task_id, world (original: the unchanged one), number,
    outcome (writes and answer; null: the run failed). Worlds with the most flipped flags and emptied values (0, null, no text)
    come first, then by number; ``limit`` of them are reported, which is the report's size.
    """
    emptied = F.col("perturbed").isNull() | F.col("perturbed").isin("0", "")
    changed = cells.where("touched").groupBy("task_id", "world").agg(F.count(F.when((F.col("kind") == "boolean") | emptied, 1)).alias("weight"))
    own = runs.where("world = 'original'").select("task_id", F.col("outcome").alias("__own"))
    same = runs.where("world like 'perturb%'").join(excluded.select("task_id", "world"), ["task_id", "world"], "left_anti").join(own, "task_id").where("outcome = __own")
    order = Window.partitionBy("task_id").orderBy(F.desc("weight"), "number", "world")  # the perturbations of one task
    out = same.join(changed, ["task_id", "world"]).withColumn("place", F.row_number().over(order))
    return out.where(F.col("place") <= limit).select("task_id", "place", "world", "weight")


def outcome_problems(processes: DataFrame) -> DataFrame:
    """world, process and problem of the outcome shapes of processes, and of what a world lacks (no process).

    ``processes``: world, process, kind, type, approval, properties (array of name, type, enums). Accounts name a reason, advice a
    recommendation and its reasons; a world has advice and one or two inquiries.
    """
    names = F.transform("properties", lambda p: p["name"])
    has = lambda words: F.exists(names, lambda n: F.regexp_like(n, F.lit(words)))
    reason = F.exists("properties", lambda p: p["name"].contains("reason") & (p["type"] == "string") & (F.coalesce(p["enums"], F.lit(0)) > 0))
    kind, shaped = F.coalesce("kind", F.lit("")), F.coalesce(F.col("type") == "object", F.lit(False))
    found = F.array_compact(
        F.array(
            F.when(~kind.isin("inquiry", "account", "advice"), "unknown kind"),
            F.when(~shaped, "the outcome is no object"),
            F.when(shaped & F.col("approval").isNotNull() & ~F.col("approval").startswith("approve_"), "the approval is no pattern"),
            F.when(shaped & (kind == "advice") & ~F.coalesce(has("recommend|choice|option") & has("reason"), F.lit(False)), "advice without recommendation and reasons"),
            F.when(shaped & (kind == "account") & ~F.coalesce(reason, F.lit(False)), "an account without a reason"),
        )
    )
    each = processes.select("world", "process", F.explode(found).alias("problem"))
    held = processes.groupBy("world").agg(F.count(F.when(kind == "advice", 1)).alias("a"), F.count(F.when(kind == "inquiry", 1)).alias("i"))
    lacks = F.array_compact(F.array(F.when(F.col("a") == 0, "no advice"), F.when(~F.col("i").between(1, 2), "not one or two inquiries")))
    return each.unionByName(held.select("world", F.lit("").alias("process"), F.explode(lacks).alias("problem")))
