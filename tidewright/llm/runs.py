"""Periodic runs of words, by the runs theorem.

A run is a maximal stretch with a smallest period that it repeats. Each run holds a longest Lyndon word of that period under
the order of words or its inverse (Bannai et al. 2017). Under one order these words end at the next smaller value of the
inverse suffix array, under the other at the next greater one, so a text has at most two candidates a word. A candidate is
extended to both sides by longest common prefixes, each the least value of a range of the LCP array of the text or of its
reverse, found in a sparse table.

Spark splits the texts and derives the results; here a task indexes the documents of a piece of an Arrow batch together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, text_of

RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: A run is this long, and this many times its period, at least.
LEAST_LENGTH, LEAST_REPEATS = 6, 4
#: Words that are indexed together; a longer text is indexed alone.
PIECE = 300_000


class SuffixIndex:
    """Inverse suffix array and LCP queries of documents laid end to end, by prefix doubling.

    A suffix ends with its document and sorts after all suffixes of earlier documents, so no two are equal and common
    prefixes never cross documents. ``levels[k]`` ranks suffixes by their first 2 ** k words, ties sharing a rank; only tied
    suffixes are ranked again. ``depth`` stops at that level.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, depth: int | None = None):
        n = len(words)
        self.end = np.searchsorted(doc, doc, side="right")
        rank = self._ties(doc.astype(np.int64) * (int(words.max()) + 1) + words)
        self.levels = [rank.astype(np.int32)]
        tied = self._tied(rank, np.arange(n))
        while len(tied) and (depth is None or len(self.levels) <= depth):
            ahead = tied + (1 << len(self.levels) - 1)
            inside = ahead < self.end[tied]
            second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
            order = np.argsort(rank[tied] * (n + 1) + second)
            at, first, second = tied[order], rank[tied][order], second[order]
            place = np.arange(len(at))
            group = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], place, 0))
            equal = np.maximum.accumulate(np.where(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])], place, 0))
            rank = rank.copy()
            rank[at] = first + equal - group
            self.levels.append(rank.astype(np.int32))
            tied = self._tied(rank, tied)
        self.tied, self.rank = tied, rank

    @staticmethod
    def _ties(keys: np.ndarray) -> np.ndarray:
        """For each key the number of smaller ones."""
        order = np.argsort(keys, kind="stable")
        ordered, out = keys[order], np.empty(len(keys), np.int64)
        out[order] = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], np.arange(len(keys)), 0))
        return out

    @staticmethod
    def _tied(rank: np.ndarray, among: np.ndarray) -> np.ndarray:
        shared = np.bincount(rank[among], minlength=len(rank)) > 1
        return among[shared[rank[among]]]

    def prepare(self) -> None:
        """The LCP of neighbours in suffix order, and the sparse table of its minima."""
        n = len(self.rank)
        suffixes = np.empty(n, np.int64)
        suffixes[self.rank] = np.arange(n)
        x, y, common = suffixes[:-1].copy(), suffixes[1:].copy(), np.zeros(n - 1, np.int32)
        live = self.end[x] == self.end[y]
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = np.minimum(x, n - 1), np.minimum(y, n - 1)
            same = live & (x < self.end[suffixes[:-1]]) & (y < self.end[suffixes[1:]]) & (self.levels[k][a] == self.levels[k][b])
            common[same] += 1 << k
            x[same] += 1 << k
            y[same] += 1 << k
        self.table = [np.r_[np.int32(0), common]]
        while 2 << len(self.table) - 1 <= n:
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes i and j, all different."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.table[k][low[of]], self.table[k][high[of] - (1 << k) + 1])
        return out


def next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value, the length where there is none."""
    out, waiting = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = i
        waiting.append(i)
    return out


def find_runs(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (place, length, period) of the runs of documents laid end to end, by place and period.

    ``doc`` numbers the documents in order, ``words`` the words in any order. A run of the least length and number of repeats
    holds four words that occur again, so documents without any leave after two doublings.
    """
    none = np.empty((0, 3), np.int64)
    places = np.arange(len(words))
    if len(words):
        again = SuffixIndex(words, doc, depth=2).tied
        places = places[np.isin(doc, doc[again])]
    if not len(places):
        return none
    words, doc = words[places], doc[places]
    index = SuffixIndex(words, doc)
    index.prepare()
    ranks, start = index.rank.tolist(), np.arange(len(words))
    after = [np.minimum(np.array(next_smaller(r), np.int64), index.end) for r in (ranks, [-r for r in ranks])]
    i, j = np.r_[start, start], np.r_[after[0], after[1]]
    i, j = i[ok := j < np.r_[index.end, index.end]], j[ok]
    right = index.common(i, j)
    enough = right > (LEAST_REPEATS - 2) * (j - i)  # the first Lyndon word of a run starts within its first period
    i, j, right = i[enough], j[enough], right[enough]
    if not len(i):
        return none
    back = np.flatnonzero(np.isin(doc, doc[i]))[::-1]  # the same documents, reversed
    mirror = SuffixIndex(words[back], -doc[back])
    mirror.prepare()
    at = np.empty(len(words), np.int64)
    at[back] = np.arange(len(back))
    left, inner = np.zeros(len(i), np.int64), (i > 0) & (doc[np.maximum(i - 1, 0)] == doc[i])
    left[inner] = mirror.common(at[i[inner] - 1], at[j[inner] - 1])
    period = j - i
    length = left + period + right
    found = np.unique(np.stack([places[i] - left, period, length], axis=1), axis=0)
    return found[found[:, 2] >= np.maximum(LEAST_LENGTH, LEAST_REPEATS * found[:, 1])][:, [0, 2, 1]]


def _pieces(sizes: np.ndarray, most: int):
    """Ranges of consecutive documents with at most so many words, or one document."""
    begin, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    yield begin, len(sizes)


def analysed(words: Column) -> Column:
    """Of an array of words: ``runs``, by start and period, and ``collapsed``, the words that no run holds after its first period, joined by spaces."""

    @F.arrow_udf(f"struct<runs:array<{RUN}>,collapsed:string>")
    def of(arrays):
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        sizes = np.asarray(pc.fill_null(pc.list_value_length(arrays), 0), np.int64)
        runs, texts = [], []
        for a, b in _pieces(sizes, PIECE) if len(sizes) else ():
            part = arrays.slice(a, b - a).flatten()
            size = sizes[a:b]
            first, doc = np.r_[0, np.cumsum(size)], np.repeat(np.arange(b - a), size)
            found = find_runs(np.asarray(part.dictionary_encode().indices, np.int64), doc)
            edge = np.zeros(len(doc) + 1, np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(edge)[:-1] == 0
            ends = np.r_[0, np.cumsum(kept)][first].astype(np.int32)
            texts.append(pc.binary_join(pa.ListArray.from_arrays(ends, part.filter(pa.array(kept))), " "))
            owner = doc[found[:, 0]] if len(found) else np.empty(0, np.int64)
            cuts = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
            columns = [pa.array(c) for c in (found[:, 0] - first[owner], found[:, 1], found[:, 2])]
            runs.append(pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(columns, names=["start", "length", "period"])))
        return pa.StructArray.from_arrays([pa.concat_arrays(runs) if runs else pa.array([], kind), pa.concat_arrays(texts) if texts else pa.array([], pa.string())], names=["runs", "collapsed"])

    return of(words)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def collapse(documents: DataFrame, text: str = "text", id: str = "doc_id", words: Column | None = None) -> DataFrame:
    """One row per document: id, runs (start and period in words from 0, length), collapsed (the text without the repeats of its runs).

    A run has the length and number of repeats named above at least and no neighbouring word extends it keeping its period.
    Of overlapping runs each is listed and drops its own repeats. ``words`` takes other arrays of words than those of the
    text. Null and empty texts have no runs and collapse to the empty text; repeated rows each give a row; an empty table gives
    none; ties of words are decided by equality alone; other columns are left out, whatever their names.
    """
    given = words_of(text_of(documents, text)) if words is None else F.coalesce(words, F.array().cast("array<string>"))
    out = documents.select(documents[id].alias(id), analysed(given).alias("__found"))
    return out.select(id, "__found.runs", "__found.collapsed")
