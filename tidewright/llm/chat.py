"""Chat formatting with a reversible template and a loss mask, as Spark expressions over sorted arrays of turns.

A block is ``<s>role[INST]part[NEXT]part[/INST]</s>``: adjacent turns of one role share a block, each turn a part of it.
Inside roles and texts a control string gets a backslash after its first character, one more where it has some already,
so no text can hold a control string and the change can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, NEXT, TEXT_END, CLOSE = "<s>", "[INST]", "[NEXT]", "[/INST]", "</s>"
_TAIL = r"(?=/?(?:s>|INST\]|NEXT\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2")


def merge_turns(turns: Column) -> Column:
    """Blocks (role, parts) of a sorted array of (role, text): adjacent turns of one role become the parts of one block."""
    size = F.size(turns)
    starts = F.filter(
        F.transform(turns, lambda x, i: F.when((i == 0) | ~x["role"].eqNullSafe(F.get(turns, i - 1)["role"]), i + 1)),
        lambda i: i.isNotNull(),
    )
    ends = F.concat(F.transform(F.slice(starts, 2, F.size(starts)), lambda i: i - 1), F.array(size))
    return F.when(size == 0, F.expr("cast(array() as array<struct<role:string,parts:array<string>>>)")).otherwise(
        F.transform(
            F.arrays_zip(starts.alias("first"), ends.alias("last")),
            lambda b: F.struct(
                F.element_at(turns, b["first"])["role"].alias("role"),
                F.transform(F.slice(turns, b["first"], b["last"] - b["first"] + 1), lambda t: t["text"]).alias("parts"),
            ),
        )
    )


def format_conversations(conversations: DataFrame, trained_role: str = "assistant", id: str = "conv_id") -> DataFrame:
    """One row per conversation: id, n_turns, formatted and loss (start and length, in code points, of each trained text).

    Turns are sorted by turn, role and text; null turns come first, null roles and texts count as empty, null ids are one
    conversation. Repeated rows are turns of their own; conversations without rows do not exist; other columns are left
    out. A conversation is one value of the result, so its turns meet in one row.
    """
    rows = conversations.select(
        conversations[id].alias("id"),
        F.struct(
            conversations["turn"].alias("turn"),
            F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"),
            F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    held = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    held = held.select("id", F.size("turns").alias("n_turns"), F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    blocks = held.select("id", "n_turns", merge_turns(F.col("turns")).alias("blocks"))
    rendered = F.transform(
        "blocks",
        lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(ROLE_END), F.array_join(b["parts"], NEXT), F.lit(TEXT_END + CLOSE)),
    )
    none = F.expr("cast(array() as array<struct<start:int,length:int>>)")

    def parts(s: Column, b: Column) -> Column:
        """The block's spans after those so far: each part starts where the part before it ended, plus a mark."""
        first = s["at"] + F.length(b["role"]) + len(OPEN + ROLE_END)
        inner = F.aggregate(
            b["parts"],
            F.struct(first.alias("at"), none.alias("spans")),
            lambda p, x: F.struct(
                (p["at"] + F.length(x) + len(NEXT)).alias("at"),
                F.array_append(p["spans"], F.struct(p["at"].alias("start"), F.length(x).alias("length"))).alias("spans"),
            ),
        )
        return F.struct(
            (inner["at"] - len(NEXT) + len(TEXT_END + CLOSE)).alias("at"),
            F.when(b["role"] == trained_role, F.concat(s["spans"], inner["spans"])).otherwise(s["spans"]).alias("spans"),
        )

    loss = F.aggregate("blocks", F.struct(F.lit(1).alias("at"), none.alias("spans")), parts, lambda s: s["spans"])
    return blocks.select(F.col("id").alias(id), F.col("n_turns").cast("long").alias("n_turns"), F.array_join(rendered, "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text), unescaped, of a formatted conversation."""
    blocks = F.filter(F.split(formatted, F.lit(OPEN)), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(F.substring(b, F.instr(b, ROLE_END) + len(ROLE_END), F.length(b)), TEXT_END, 1), r"\[NEXT\]", -1),
                lambda t: F.struct(unescape(F.substring_index(b, ROLE_END, 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda m: unescape(F.substring(formatted, m["start"], m["length"]))), "")
