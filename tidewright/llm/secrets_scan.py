"""Secret scans: base patterns, and more spans by the likelihood of inferred formats.

The values of the base spans are labelled credentials. Of each kind a bounded sample becomes a probabilistic automaton, whose
limit is the least likelihood of the sample under it. A second pass scores every candidate: one that is at least that likely, and
so much more likely than under a model of ordinary words that it outweighs how much rarer
credentials are, is a span too. Lengths are no gate: near ones are
a little less likely.
The model of ordinary words counts all texts; its counts are rates per 5,000 texts, so it does not sharpen with the table. The
values of the automata are chosen by hash, a place in each of a fixed number of buckets.

Candidates are the maximal runs of the characters of credentials outside the base spans, dots at their ends left out, and
where such a run holds ``=``, its parts on both sides. One pass finds values and counts words; they meet in a shuffle, and the
sample of values and the words' trigrams, bounded by the alphabet, come to the driver; no value is written to a table.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automata import Automaton, Lengths, WordModel, likelihood

KINDS = ("assign", "access", "hex")
SPAN = "struct<kind:int,start:int,end:int>"

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("passw", "secret", "token", "api")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: The least length of a value of the base patterns.
LEAST = 6
#: How many ordinary words a corpus holds for one credential outside the base patterns.
ODDS = 1e5


@dataclass
class Format:
    """What a kind of credential looks like: the least likelihood of its values, the automaton's table, and their lengths."""

    kind: int
    limit: float
    table: list
    lengths: Lengths

    def likelihood(self, word: str) -> float:
        """Mean log probability per character, of the characters and of the length."""
        return likelihood(self.table, word) + self.lengths.likelihood(len(word)) / (len(word) + 1)


def base_spans(text: str) -> list[dict]:
    """Spans of the base patterns, leftmost and non-overlapping per kind, in order of start and kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS) or not low.isascii():
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return [{"kind": k, "start": a, "end": b, "value": v} for a, k, b, v in sorted(out)]


def candidates(text: str, spans: list[dict], least: int = LEAST) -> list[list[tuple[int, int]]]:
    """Per run of credential characters outside the spans: its place and, if it holds ``=``, those of its parts; ``least`` is the least length."""
    covered: list[list[int]] = []
    for s in spans:
        if covered and s["start"] <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], s["end"])
        else:
            covered.append([s["start"], s["end"]])
    out, first = [], 0
    for m in re.finditer(r"[A-Za-z0-9+/_.=-]{%d,}" % max(1, least), text):
        free, at = [], m.start()
        while first < len(covered) and covered[first][1] <= at:
            first += 1
        for low, high in covered[first:] if first < len(covered) and covered[first][0] < m.end() else ():
            if low >= m.end():
                break
            free.append((at, low))
            at = max(at, high)
        for a, b in [*free, (at, m.end())]:
            value = text[a:b] if a < b else ""
            a, b = a + len(value) - len(value.lstrip(".")), a + len(value.rstrip("."))
            places = [(a, b)]
            if "=" in text[a:b].strip("="):
                places += [(a + p.start(), a + p.end()) for p in re.finditer(r"[^=]+", text[a:b])]
            out.append([(x, y) for x, y in places if y - x >= least])
    return [p for p in out if p]


def values_and_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """kind and value of the base spans, and with kind -1 the candidates (whole runs) outside them; n, twice (whether a text holds it so), and least and greatest hash of the texts.

    A row for each distinct word of some of a task's texts: equal words are added up before they move.
    """

    def of(batches):
        from collections import Counter

        import pyarrow as pa

        counts, twice, low, high = Counter(), set(), {}, {}
        run = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)

        def added():
            rows = [(*(w if isinstance(w, tuple) else (-1, w.strip("."))), n, w in twice, low[w], high.get(w, low[w])) for w, n in counts.items()]
            columns = list(zip(*(r for r in rows if r[0] >= 0 or len(r[1]) >= LEAST), strict=True)) or [()] * 6
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "value", "n", "twice", "low", "high"])

        for batch in batches:
            for value, h in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                value = value.as_py()
                base = base_spans(value)
                if base:
                    words = [value[a:b] for places in candidates(value, base) for a, b in places[:1]] + [(s["kind"], s["value"]) for s in base]
                else:
                    words = run.findall(value)
                own = Counter(words)
                counts.update(own)
                if len(own) < len(words):
                    twice.update(w for w, n in own.items() if n > 1)
                for w in own:
                    if low.setdefault(w, h) != h:
                        high[w] = h
                if len(counts) > 200_000:
                    yield added()
                    counts.clear(), twice.clear(), low.clear(), high.clear()
        yield added()

    texts = documents.select(documents[text].cast("string").alias("text")).where("text is not null").select("text", F.xxhash64("text").alias("h"))
    found = texts.mapInArrow(of, "kind int, value string, n long, twice boolean, low long, high long")
    merged = [F.sum("n").alias("n"), F.bool_or("twice").alias("twice"), F.min(F.least("low", "high")).alias("low"), F.max(F.greatest("low", "high")).alias("high")]
    return found.groupBy("kind", "value").agg(*merged)


def models(documents: DataFrame, sample: int = 400, slack: float = 0.35, per: int = 5000, text: str = "text") -> tuple[list[Format], WordModel]:
    """The formats of the base values, and the model of the ordinary words, of all documents.

    Per kind the automaton comes from at most ``sample`` distinct values, the least by hash in each of so many buckets. The limit
    is the least likelihood of these, lowered by ``slack``. Ordinary are the candidates that stand in two different texts or twice in
    one, and twice or more in ``per`` texts on average. The model has the counts of their trigrams in all texts, over so many where there are more.
    """
    times = max(1.0, documents.count() / per)
    h, line = F.xxhash64("value"), F.concat(F.lit("\n\n"), "value", F.lit("\n"))
    place = lambda at, h, value: F.struct(at.cast("string").alias("at"), h.alias("h"), value.alias("value"))
    grams = F.transform(F.sequence(F.lit(1), F.length("value") + 1), lambda i: place(F.substr(line, i, F.lit(3)), F.lit(None).cast("long"), F.lit(None).cast("string")))
    rows = values_and_words(documents, text).where(F.expr("kind >= 0") | ((F.col("n") >= 2 * times) & (F.col("twice") | (F.col("low") < F.col("high")))))
    parts = F.when(F.col("kind") >= 0, F.array(place(F.pmod(h, F.lit(sample)), h, F.col("value")))).otherwise(grams)
    found = rows.select("kind", "n", F.inline(parts)).groupBy("kind", "at").agg(F.sum("n").alias("n"), F.min(F.struct("h", "value"))["value"].alias("value")).collect()
    formats = []
    for k in range(len(KINDS)):
        words = sorted(r["value"] for r in found if r["kind"] == k)
        if words:
            one = Format(k, 0.0, Automaton(words).merged().table(), Lengths(words))
            one.limit = min(map(one.likelihood, words)) - slack
            formats.append(one)
    return formats, WordModel.of_trigrams({r["at"]: r["n"] / times for r in found if r["kind"] < 0})


def learn(documents: DataFrame, sample: int = 400, slack: float = 0.35, text: str = "text") -> list[Format]:
    """The formats of ``models``."""
    return models(documents, sample, slack, text=text)[0]


def ordinary_words(documents: DataFrame, per: int = 5000, text: str = "text") -> WordModel:
    """The model of the ordinary words of ``models``."""
    return models(documents, per=per, text=text)[1]


def best_format(word: str, formats: list[Format], ordinary: WordModel, odds: float) -> int:
    """The kind of the format that a word is likeliest under, of those that admit it, if that is ``odds`` times as likely as under the ordinary words; else -1."""
    p, kind = max(((p, -f.kind) for f in formats if (p := f.likelihood(word)) >= f.limit), default=(None, 1))
    if p is None or (p - ordinary.likelihood(word)) * (len(word) + 1) < math.log(odds):
        return -1
    return -kind


def spans(text: Column, formats: list[Format], ordinary: WordModel, odds: float = ODDS) -> Column:
    """base and added spans (kind, start, end) of a text, in code points and order; null counts as empty."""
    @F.arrow_udf(f"struct<base:array<{SPAN}>,added:array<{SPAN}>>")
    def of(texts):
        import pyarrow as pa

        seen: dict[str, int] = {}

        def kind_of(word: str) -> int:
            k = seen.get(word)
            if k is None:
                if len(seen) >= 100_000:
                    seen.clear()
                k = seen[word] = best_format(word, formats, ordinary, odds)
            return k

        def both(value: str) -> dict:
            base, added = base_spans(value), []
            for places in candidates(value, base) if formats else ():
                whole, *parts = [(kind_of(value[a:b]), a, b) for a, b in places]
                added += [x for x in ([whole] if whole[0] >= 0 else parts) if x[0] >= 0]
            place = lambda k, a, b: {"kind": k, "start": a, "end": b}
            return {"base": [place(s["kind"], s["start"], s["end"]) for s in base], "added": [place(*x) for x in added]}

        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([both(t.as_py() or "") for t in texts], pa.struct([("base", kind), ("added", kind)]))

    return of(text.cast("string"))


def scan(documents: DataFrame, sample: int = 400, odds: float = ODDS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """id, base (kind, start, end) and added (kind, start, end) of every row, both in order.

    An added span's kind is the format that it is likeliest under. Null and empty texts have no spans, a null id is kept,
    repeated rows each get a row, an empty table gives an empty result, other columns are left out.
    """
    formats, ordinary = models(documents, sample, text=text)
    found = spans(documents[text], formats, ordinary, odds)
    return documents.select(documents[id].alias(id), found.alias("__found")).select(id, "__found.base", "__found.added")
