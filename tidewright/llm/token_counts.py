"""Token counts by a tokenizer compiled into a finite-state transducer.

Byte-pair merges are a regular function: of every prefix of a text the last token is the one whose pair with the last token
of the prefix before it stays as it is when merged alone (Berglund et al. 2024). A state of the transducer therefore holds the
last tokens of the few prefixes at which a token that still may grow can begin, and each transition is annotated with the
number of tokens that reading its character adds, which is negative where tokens merge. States are made when first reached and
dropped together beyond a bound, and so are words walked as one transition.

Spark cuts texts into chunks. The state map of a chunk gives, for each state that may stand before it, the state after it
and the tokens emitted; the maps of a text's chunks compose through a parallel prefix scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of

SPACE_MARK = "▁"
#: Characters of a chunk.
CHUNK = 4096
#: Transitions, and words walked as one, that a worker keeps.
TRANSITIONS, WORDS = 700_000, 300_000

StateMap = dict["State", tuple["State", int]]


class State(dict):
    """Transitions by character, each to (state, tokens added); made by the transducer when first used.

    ``prefixes`` lists (characters back, last token there, tokens there less tokens here); the token is None where nothing
    before can merge with what follows.
    """

    __slots__ = ("prefixes", "tail", "transducer")

    def __init__(self, transducer: Transducer, tail: str, prefixes: tuple):
        self.transducer, self.tail, self.prefixes = transducer, tail, prefixes

    def __hash__(self) -> int:
        return id(self)

    def __eq__(self, other) -> bool:
        return self is other

    def __missing__(self, c: str) -> tuple[State, int]:
        self[c] = out = self.transducer.transition(self, c)
        return out


class Transducer:
    """Deterministic transducer of a merge tokenizer.

    ``scores`` has the score of every token that merging may form; of two pairs the one whose union has the higher score merges first,
    of equal ones the first. A character that is no token costs its UTF-8 bytes.
    """

    def __init__(self, scores: dict[str, float], limit: int = TRANSITIONS):
        self.scores, self.limit = scores, limit
        ordered = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {token: ordered[score] for token, score in scores.items()}
        assert not any(SPACE_MARK in t.lstrip(SPACE_MARK) for t in scores), "a token reaches over a space"
        self.reach = max(map(len, scores))
        self.growing = {t[:k] for t in scores for k in range(1, len(t))}
        self.known = self.growing | scores.keys()
        self.stays: dict[tuple[str, str], bool] = {}
        self.split: dict[str, tuple[str, str] | None] = {}
        self.bound: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.made = 0
        self.words: dict[str, tuple[State, int]] = {}
        self.stays.clear()
        self.bound.clear()
        self.states: dict[tuple, State] = {}
        self.start = self.state("", ((0, None, 0),))

    def state(self, tail: str, prefixes: tuple) -> State:
        found = self.states.get((tail, prefixes))
        if found is None:
            found = self.states[tail, prefixes] = State(self, tail, prefixes)
        return found

    def merged(self, text: str) -> tuple[list[str], list[str]]:
        """The tokens of a short text by plain merging, and those before the last merge."""
        parts, before = list(text), []
        while True:
            pairs = [(self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not pairs:
                return parts, before
            _, k = min(pairs)
            before = list(parts)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def halves(self, token: str) -> tuple[str, str] | None:
        """What the last merge of a token joins; None for one that merging does not form, twice the character for a character."""
        if token not in self.split:
            parts, before = self.merged(token)
            self.split[token] = (token, token) if len(token) == 1 else (before[0], before[1]) if len(parts) == 1 else None
        return self.split[token]

    def kept(self, last: str | None, token: str) -> bool:
        """Whether a token stands as it is after the token ``last``.

        It does unless, going back through the merges of both from the latest, the parts at their border would have merged
        earlier. Tokens of spaces alone share one rank, so theirs are merged plainly.
        """
        if self.halves(token) is None:
            return False
        if last is None or not self.touching(last, token):
            return True
        key = (last, token)
        if key in self.stays:
            return self.stays[key]
        if not last.strip(SPACE_MARK) or not token.strip(SPACE_MARK):
            out = self.merged(last + token)[0] == [last, token]
        else:
            a, b, limit = last, token, math.inf
            age = lambda t: self.rank[t] if len(t) > 1 else -1
            while (out := a + b not in self.rank or self.rank[a + b] >= limit) and max(age(a), age(b)) >= 0:
                if age(a) > age(b):
                    limit, a = age(a), self.halves(a)[1]
                else:
                    limit, b = age(b) + 1, self.halves(b)[0]
        self.stays[key] = out
        return out

    def touching(self, last: str, tail: str) -> bool:
        """Whether some token reaches from inside ``last`` into a text that starts with ``tail``."""
        key = (last, tail)
        if key not in self.bound:
            ends = [last[k:] for k in range(len(last)) if last[k:] + tail[0] in self.known]
            self.bound[key] = any(e + tail in self.known or any(e + tail[:k] in self.scores for k in range(1, len(tail))) for e in ends)
        return self.bound[key]

    def transition(self, state: State, c: str) -> tuple[State, int]:
        self.made += 1
        c = SPACE_MARK if c == " " else c
        tail, last, added = state.tail, c, None
        for back, before, less in state.prefixes:
            token = tail[len(tail) - back :] + c
            if (back == 0 or token in self.scores) and self.kept(before, token):
                last, added = token, less + (1 if token in self.scores else len(c.encode()))
                break
        after = [(0, last if c in self.scores else None, 0)]
        for back, before, less in state.prefixes:
            grown = tail[len(tail) - back :] + c
            if grown in self.growing:
                after.append((back + 1, before if before and self.touching(before, grown) else None, less - added))
        longest = max(back for back, _, _ in after)
        return self.state((tail + c)[len(tail) + 1 - longest :], tuple(after)), added

    def walk(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for c in text:
            state, added = state[c]
            total += added
        return state, total

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text and the tokens emitted.

        No token reaches over the start of a space that follows another character, so there all states meet, and the walk
        over a space and the word behind it is one transition, kept by the word.
        """
        first, *words = text.split(" ")
        state, total = self.walk(state, first)
        for word in words:
            if not first or first[-1] == SPACE_MARK or not word:
                state, added = self.walk(state, " " + word)
            elif word in self.words:
                state, added = self.words[word]
            else:
                if len(self.words) >= WORDS:
                    self.words.clear()
                state, added = self.words[word] = self.walk(self.start, " " + word)
            total += added
            first = word
        return state, total

    def state_maps(self, chunks: list[str]) -> list[StateMap]:
        """The state map of each chunk of a text, the first from the start.

        A later chunk is entered in a state that its left context decides: as candidates stand the states after reading that
        context from each place as if nothing before could merge. A text in which no such place is free may enter in another,
        which is added.
        """
        maps: list[StateMap] = [{self.start: self.run(self.start, chunks[0])}]
        for before, chunk in zip(chunks, chunks[1:], strict=False):
            context = before[-2 * self.reach :]
            candidates = {self.run(self.start, context[k:])[0] for k in range(min(self.reach, len(context)))}
            maps.append({s: self.run(s, chunk) for s in candidates})
        for k in range(1, len(maps)):
            for end, _ in maps[k - 1].values():
                if end not in maps[k]:
                    maps[k][end] = self.run(end, chunks[k])
        return maps

    def count(self, chunks: list[str]) -> int:
        """Tokens of the text that the chunks make up."""
        if self.made > self.limit:
            self.clear()
        return prefix_scan(self.state_maps(chunks))[-1][self.start][1] if chunks else 0


def composed(first: StateMap, then: StateMap) -> StateMap:
    return {s: (then[e][0], n + then[e][1]) for s, (e, n) in first.items()}


def prefix_scan(maps: list[StateMap]) -> list[StateMap]:
    """The maps of all prefixes of the chunks, in rounds of doubled distance."""
    step = 1
    while step < len(maps):
        maps = [m if k < step else composed(maps[k - step], m) for k, m in enumerate(maps)]
        step *= 2
    return maps


@lru_cache(maxsize=1)
def piece_transducer(path: str) -> Transducer:
    """The transducer of a sentencepiece BPE model with byte fallback and the identity as normaliser; a worker keeps it for its next tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Transducer(dict(zip(model.id_to_piece(ids), model.get_score(ids), strict=True)))


def chunks_of(text: Column, size: int = CHUNK) -> Column:
    """The text in chunks of so many characters, none for an empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def counted(chunks: Column, compiled: Callable[[], Transducer]) -> Column:
    """Number of tokens of the text that an array of chunks makes up; the model puts a space before a text that is not empty."""

    @F.arrow_udf("long")
    def of(arrays):
        import pyarrow as pa

        transducer = compiled()
        return pa.array([transducer.count([" " + c if k == 0 else c for k, c in enumerate(a.as_py() or ())]) for a in arrays], pa.int64())

    return of(chunks)


def count_tokens(documents: DataFrame, model: str, limit: int = 4096, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens by the sentencepiece BPE file ``model``, over_limit.

    Counts are those of the model's library: no tokens for the begin or end, strings of special tokens are plain text. Null
    texts count as empty and have no tokens; white space is tokens like any; repeated rows each give a row; an empty table
    gives none; other columns are left out, whatever their names.
    """
    out = documents.select(documents[id].alias(id), text_of(documents, text).alias("__text"))
    out = out.select(id, F.octet_length("__text").cast("long").alias("n_bytes"), counted(chunks_of(F.col("__text")), lambda: piece_transducer(model)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
