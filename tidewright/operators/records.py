"""Records named in states and speech: known strings, other names, what was said, and what an episode shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.functions.numerals import says, stated_numbers

# Words of tools that establish who the user is.
IDENTITY = ("verify", "identity", "authenticat", "lookup_customer", "find_customer", "find_user", "get_user", "lookup_user", "get_customer")


def nameable(value: Column) -> Column:
    """A text that a person would say: of three characters or more, with a space inside or a capital, not all digits."""
    words = F.trim(value).contains(" ") | F.regexp_like(value, F.lit(r"\p{Lu}"))
    digits = F.regexp_like(F.regexp_replace(value, "[-_]", ""), F.lit(r"^[0-9]+$"))
    return F.coalesce((F.length(value) >= 3) & words & ~digits, F.lit(False))


def referable_ids(cells: DataFrame) -> DataFrame:
    """Distinct row_id of rows with a cell (row_id, column, value), other than the id, that a person can name."""
    return cells.where((F.col("column") != "id") & nameable(F.col("value"))).select("row_id").distinct()


def known_strings(requests: DataFrame, facts: DataFrame, cells: DataFrame) -> DataFrame:
    """request_id and known: the opening, the texts among the user's facts, and the ids of rows that a person can name.

    ``requests``: request_id, user_request. ``facts``: request_id, value. ``cells``: request_id, row_id, column, value.
    """
    said = requests.select("request_id", F.coalesce("user_request", F.lit("")).alias("text"))
    told = facts.where("value is not null").select("request_id", F.col("value").alias("text"))
    ids = cells.where((F.col("column") != "id") & nameable(F.col("value"))).select("request_id", F.col("row_id").alias("text"))
    return said.unionByName(told).unionByName(ids).groupBy("request_id").agg(F.array_sort(F.collect_set("text")).alias("known"))


def alias_matches(leaves: DataFrame, aliases: DataFrame) -> DataFrame:
    """leaves (expected, actual) with ``renamed``: the answer is another name of the expected record.

    ``aliases`` (alias, row_id) has one row a name, as joins.aliases gives it.
    """
    names = aliases.select(F.col("alias").alias("__a"), F.col("row_id").alias("__r"))
    joined = leaves.withColumn("__k", S.ascii_key(F.col("actual"))).join(names, F.col("__k") == F.col("__a"), "left")
    return joined.withColumn("renamed", F.coalesce(F.col("__r") == F.col("expected"), F.lit(False))).drop("__k", "__a", "__r")


def record_names(rows: DataFrame, most: int = 120, names: int = 3) -> DataFrame:
    """episode_id, row_id and names: the first naming texts of the records that good results returned, the first ``most`` records.

    ``rows``: episode_id, seq (of the result), place (of the record in it), row_id, cells (array of column and value in order).
    """
    held = F.slice(F.transform(F.filter("cells", lambda c: (c["column"] != "id") & (F.length(c["value"]) >= 3) & ~F.regexp_like(F.regexp_replace(c["value"], "[-_]", ""), F.lit("^[0-9]+$"))), lambda c: c["value"]), 1, names)
    first = rows.withColumn("names", held).where(F.size("names") > 0).groupBy("episode_id", "row_id").agg(F.min(F.struct("seq", "place", "names")).alias("f"))
    # An episode has a bounded report of records: the limit is the feature.
    listed = first.groupBy("episode_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("f.seq", "f.place", "row_id", "f.names"))), 1, most).alias("x"))
    return listed.select("episode_id", F.inline("x")).select("episode_id", "row_id", "names")


def speech(trace: DataFrame) -> DataFrame:
    """episode_id and said: the chat messages of a trace (episode_id, seq, kind, message) in order."""
    rows = trace.where((F.col("kind") == "chat") & F.col("message").isNotNull())
    return rows.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("seq", "message")))["message"].alias("said"))


def skills(calls: DataFrame, last_words: DataFrame, recovered: DataFrame, episodes: DataFrame) -> DataFrame:
    """episode_id and the sorted behaviours that an episode shows.

    ``calls``: episode_id, name, arguments, result, failed, write, and consent, the episode's name of the argument for consent (null: consent). ``last_words``: episode_id, asked, one row a write.
    ``recovered``: episode_id, recovered. ``episodes``: episode_id, world, goals, out_of_scope, pushback.
    """
    name = F.lower("name")
    proposal = F.contains("arguments", F.lit('"proposal"'))
    consent = F.contains("arguments", F.concat(F.lit('"'), F.coalesce("consent", F.lit("consent")), F.lit('"')))
    identity = F.lit(False)
    for word in IDENTITY:
        identity = identity | name.contains(word)
    shown = lambda rows, **rules: rows.select("episode_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))).alias("skill"))
    found = shown(
        calls,
        asks_consent=proposal, handles_refusal=proposal & F.regexp_like("result", F.lit('"consent": (null|None)')),
        writes=(F.col("write") | consent) & ~F.col("failed"), verifies_identity=identity,
    )
    found = found.unionByName(shown(last_words, asks_consent=F.col("asked"))).unionByName(shown(recovered, recovers_from_error=F.col("recovered")))
    found = found.unionByName(shown(episodes, refusal_world=F.col("world").startswith("flip"), multi_goal=F.col("goals") >= 2, out_of_scope=F.col("out_of_scope"), pushback=F.col("pushback")))
    held = found.groupBy("episode_id").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    return episodes.select("episode_id").join(held, "episode_id", "left").select("episode_id", F.coalesce("skills", F.expr("cast(array() as array<string>)")).alias("skills"))


def persona(key: Column, personas: int) -> Column:
    """The number of the persona of a key: the first 15 hex digits of its SHA-256, modulo their number."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("long"), F.lit(personas))


def unsaid_numbers(rows: DataFrame, opening: str = "opening", numbers: str = "numbers") -> DataFrame:
    """Adds ``missing``: the numbers of a scene (array) that its opening does not say, in order."""
    stated = rows.withColumn("__s", stated_numbers(F.col(opening)))
    return stated.withColumn("missing", F.array_sort(F.filter(numbers, lambda x: ~says(F.col("__s"), x)))).drop("__s")


def fact_topics(facts: DataFrame) -> DataFrame:
    """request_id and the sorted topics ``key: kind: description`` of facts (request_id, key, value, description)."""
    kind = F.when(F.col("key").startswith("approve") & F.col("value").isin("true", "false"), "approval").otherwise("fact")
    return facts.groupBy("request_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "key", kind, F.coalesce("description", F.lit(""))))).alias("topics"))
