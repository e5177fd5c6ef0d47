"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is split into k + 1 pieces; a passage within k edits of the item holds at least one
piece unchanged. Exact piece hits are found for all items at once with an Aho-Corasick automaton, and the text around a
hit is verified with Myers' bit-parallel edit distance. Documents are never moved: items go to the documents, in blocks
of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "array<struct<item_id:bigint,distance:int,start:int,end:int>>"


def normal(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(mask: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance of an item to any stretch of the text, and where the first such stretch ends (Myers 1999)."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, end = full, 0, length, length, 0
    for at, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(x | plus)), plus & x
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down, carry = (up << 1) & full, (down << 1) & full, eq | minus
        plus, minus = down | (full & ~(carry | up)), up & carry
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds a block of test items in texts. Windows around hits of one item that overlap are verified as one."""

    def __init__(self, items: list[tuple[int, str]], errors: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * errors), masks(t)) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget, _) in enumerate(self.items):
            for offset, piece in pieces(t, budget):
                at.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        begins: dict[int, list[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for k, offset in places:
                begins.setdefault(k, []).append(end + 1 - length - offset)
        for k, starts in begins.items():
            _, item, budget, _ = self.items[k]
            low = high = None
            for s in sorted(starts):
                a, b = max(0, s - budget), s + len(item) + budget
                if low is not None and a <= high and b - low <= 8 * len(item):
                    high = b
                    continue
                if low is not None:
                    yield k, low, high
                low, high = a, b
            yield k, low, high

    def matches(self, text: str) -> list[dict]:
        found: dict[int, dict] = {}
        for k, low, high in self.windows(text):
            i, item, budget, mask = self.items[k]
            distance, end = best_match(mask, len(item), text[low:high])
            if distance <= budget and (k not in found or distance < found[k]["distance"]):
                found[k] = {"item_id": i, "distance": distance, "start": max(0, low + end - len(item)), "end": low + end}
        return [found[k] for k in sorted(found)]


def blocks(benchmark: DataFrame, block_chars: int = 2_000_000, text: str = "text", id: str = "item_id") -> Iterator[list[tuple[int, str]]]:
    """The items, normalised, in blocks of at most ``block_chars`` characters (or one item); items without text have none."""
    block, held = [], 0
    for row in benchmark.select(benchmark[id].alias("id"), benchmark[text].cast("string").alias("text")).toLocalIterator():
        item = normal(row["text"] or "")
        if block and held + len(item) > block_chars:
            yield block
            block, held = [], 0
        if item:
            block.append((row["id"], item))
            held += len(item)
    if block:
        yield block


def leaks(text: Column, items: list[tuple[int, str]], errors: float = 0.05) -> Column:
    """The items of a block that a text holds: item_id, distance, and where the passage lies in the normalised text."""
    ready: list[Matcher] = []

    @F.arrow_udf(RESULT)
    def of(texts):
        import pyarrow as pa

        if not ready:
            ready.append(Matcher(items, errors))
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([ready[0].matches(normal(t.as_py() or "")) for t in texts], kind)

    return of(text.cast("string"))


def contaminated(documents: DataFrame, benchmark: DataFrame, errors: float = 0.05, block_chars: int = 2_000_000, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document and test item that it holds: id, item_id, distance, start, end.

    An item of m characters is held if some stretch of the document is within floor(m * errors) edits, both normalised.
    Null and empty texts and items match nothing; repeated rows each give their rows; an empty table on either side gives
    an empty result; other columns are left out.
    """
    parts = [
        documents.select(documents[id].alias(id), F.inline(leaks(documents[text], items, errors))) for items in blocks(benchmark, block_chars)
    ]
    if not parts:
        none = F.expr(f"cast(array() as {RESULT})")
        return documents.select(documents[id].alias(id), F.inline(none))
    return reduce(DataFrame.unionByName, parts)


def without_leaks(documents: DataFrame, benchmark: DataFrame, errors: float = 0.05, block_chars: int = 2_000_000, text: str = "text") -> DataFrame:
    """The documents that hold no test item, with their columns, whatever their names.

    Null and empty texts and items hold and match nothing, so such documents stay; repeated rows stay or go together; an empty
    table on either side leaves documents as they are.
    """
    out = documents
    for items in blocks(benchmark, block_chars):
        out = out.where(F.size(leaks(out[text], items, errors)) == 0)
    return out
