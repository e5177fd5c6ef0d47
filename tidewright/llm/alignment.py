"""Cross-tokenizer alignment: which tokens of two tokenizers overlap, where both end, and how often each pair of ids meets.

A task encodes its documents in batches and lays them end to end as two interval tables in DuckDB. ASOF joins find the
token of the other table that covers a token's start, a range condition on the ends keeps those that begin inside it, and
window sums over the shared starts number the groups. Each batch gives partial pair counts, which Spark merges; the merged
counts return to the batches, bounded as they are, to score their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import text_of, written

#: Characters of the texts of a batch; a longer text is a batch alone.
BATCH = 1_000_000
#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary(NamedTuple):
    encode: Callable[[list[str]], list[Sequence[int]]]  # without special tokens
    bytes: list[bytes]  # of each id
    prefix: str  # what the caller puts before a text, where the tokenizer itself puts none
    lossless: bool  # whether the bytes of the tokens of a text are always those of the text


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library.

    Where ids are in the order of merges, tiktoken encodes with the same vocabulary, several times faster; a text that is too
    much for its pattern search goes to the file's own library.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    letters, vocab = byte_alphabet(), model["model"]["vocab"]
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    names = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]))
    for token, i in ranks.items():
        names[i] = token
    merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
    assert all(vocab["".join(m)] == 256 + k for k, m in enumerate(merges)), "ids are not in the order of merges"
    fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @lru_cache(maxsize=1)
    def own() -> Tokenizer:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encode(text: str) -> Sequence[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as error:  # a panic of the pattern search is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                raise
            return own().encode(text, add_special_tokens=False).ids

    return Vocabulary(lambda texts: [encode(t) for t in texts], names, " ", model["normalizer"] is None)


@lru_cache(maxsize=2)
def sentence_pieces(path: str) -> Vocabulary:
    """A sentencepiece file, whose model puts a space before each text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        names.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), names, "", False)


class Aligned(NamedTuple):
    """Of a batch: numbers of each document, its groups spelled out, the pairs (a, b, n) of the batch, and (document, pair, n) by document."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pairs: dict[str, np.ndarray]
    held: dict[str, np.ndarray]


def flat(tokens: list[Sequence[int]]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int32), *[np.asarray(t, np.int32) for t in tokens]])


def come_back(texts: list[str], tokens: list[Sequence[int]], vocabulary: Vocabulary) -> list[bool]:
    """Whether the bytes of its tokens are those of a space and the text; not for an empty text."""
    if vocabulary.lossless:
        return [t != "" for t in texts]
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(vocabulary.bytes, pa.binary()).take(pa.array(flat(tokens)))), b"")
    same = pc.equal(joined, pa.array([(" " + t).encode() for t in texts], pa.binary()))
    return [bool(t) and s for t, s in zip(texts, same.to_pylist(), strict=True)]


def intervals(tokens: list[Sequence[int]], lengths: np.ndarray):
    import pyarrow as pa

    ids = flat(tokens)
    end = np.cumsum(lengths[ids]).astype(np.int32)  # a batch has less than 2 GB
    return pa.table({"doc": np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens]), "id": ids, "s": end - lengths[ids].astype(np.int32), "e": end})


@lru_cache(maxsize=1)
def _written_ids(most: int):
    """The ids after a comma, after a semicolon and after a bar."""
    import pyarrow as pa

    return pa.array([f"{mark}{i}" for mark in ",;|" for i in range(most)])


def spelled(sides: list[dict], docs: int) -> list[str]:
    """The groups of each document, from the ids, group numbers and first tokens of groups on either side, in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    order = np.argsort(np.r_[2 * sides[0]["g"].astype(np.int64), 2 * sides[1]["g"].astype(np.int64) + 1], kind="stable")
    most = 1 << int(max([0, *(x["id"].max(initial=0) for x in sides)])).bit_length()
    pieces = np.concatenate([x["id"] + most * (k + 1) * x["opens"] for k, x in enumerate(sides)])[order]
    cuts = np.searchsorted(np.concatenate([x["doc"] for x in sides])[order], np.arange(docs + 1)).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(cuts, _written_ids(most).take(pa.array(pieces))), "")
    return [t[1:] for t in joined.to_pylist()]


def numbered(db, id: str, opens: str, table: str) -> dict[str, np.ndarray]:
    """The tokens of a side in order: doc, s, id, whether a token opens a group, and the group's number, the starts summed so far.

    The join leaves its rows in order, so the window can run over them as they come; where it has not, they are ordered first.
    """
    query = f"SELECT doc, s, {id} AS id, {opens} AS opens, sum(({opens})::INT) OVER ({{}} ROWS UNBOUNDED PRECEDING)::INT AS g FROM {table}"
    out = db.execute(query.format("")).fetchnumpy()
    if np.any(np.diff(out["s"]) <= 0):
        out = db.execute(query.format("ORDER BY s") + " ORDER BY s").fetchnumpy()
    return out


def align_batch(db, a: list[Sequence[int]], b: list[Sequence[int]], lengths_a: np.ndarray, lengths_b: np.ndarray) -> Aligned:
    """Aligns documents whose tokens cover the same bytes in both tokenizers."""
    docs = len(a)
    tables = {"tokens_a": intervals(a, lengths_a), "tokens_b": intervals(b, lengths_b)}
    for name, table in tables.items():
        db.register(name, table)
    db.execute("CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM tokens_a")
    db.execute("CREATE OR REPLACE TEMP TABLE b AS SELECT * FROM tokens_b")
    for name in tables:
        db.unregister(name)
    db.execute("CREATE OR REPLACE TEMP TABLE at_a AS SELECT a.doc, a.s, a.id AS a, b.id AS b, b.s = a.s AS opens FROM a ASOF JOIN b ON b.s <= a.s")
    db.execute("CREATE OR REPLACE TEMP TABLE at_b AS SELECT b.doc, b.s, a.id AS a, b.id AS b, a.s < b.s AND b.s < a.e AS inside FROM b ASOF JOIN a ON a.s <= b.s")
    db.execute("CREATE OR REPLACE TEMP TABLE links AS SELECT doc, a, b FROM at_a UNION ALL SELECT doc, a, b FROM at_b WHERE inside")
    db.execute("CREATE OR REPLACE TEMP TABLE pairs AS SELECT (row_number() OVER () - 1)::INT AS pair, a, b, n FROM (SELECT a, b, count(*)::INT AS n FROM links GROUP BY a, b)")
    pairs = db.execute("SELECT a, b, n FROM pairs ORDER BY pair").fetchnumpy()
    held = db.execute("SELECT doc, pair, count(*)::INT AS n FROM links JOIN pairs USING (a, b) GROUP BY doc, pair ORDER BY doc, pair").fetchnumpy()
    count = lambda values, weights=None: np.bincount(values, weights, minlength=docs).astype(np.int64)
    sides = [numbered(db, *x) for x in (("a", "opens", "at_a"), ("b", "NOT inside", "at_b"))]
    starts = count(sides[0]["doc"], sides[0]["opens"])
    return Aligned(np.array([len(t) for t in a]), np.array([len(t) for t in b]), starts, count(held["doc"], held["n"]), spelled(sides, docs), pairs, held)


def _batches(record_batches, most: int) -> Iterator[tuple[list, list[str]]]:
    """Ids (as Arrow arrays) and texts, so many characters at a time."""
    for batch in record_batches:
        begin, held, texts = 0, 0, []
        for k, text in enumerate(batch.column(1)):
            text = text.as_py()
            if texts and held + len(text) > most:
                yield batch.column(0).slice(begin, k - begin), texts
                begin, held, texts = k, 0, []
            texts.append(text)
            held += len(text)
        if texts:
            yield batch.column(0).slice(begin), texts


def _table_kind(id: T.DataType) -> T.StructType:
    out = T.StructType().add("batch", T.LongType()).add("place", T.IntegerType()).add("id", id)
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        out = out.add(name, T.LongType())
    out = out.add("groups", T.StringType())
    for name in ("a", "b", "pair", "n"):
        out = out.add(name, T.ArrayType(T.IntegerType()))
    return out


def aligned_batches(documents: DataFrame, a: Callable[[], Vocabulary], b: Callable[[], Vocabulary], spelled: bool, most: int = BATCH) -> DataFrame:
    """For each document its numbers, groups (spelled, or their SHA-256) and pairs, numbered in its batch; for each batch, with no place, its pairs and their counts."""
    kind = _table_kind(documents.schema[0].dataType)

    def run(record_batches):
        import duckdb
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        first, second = a(), b()
        lengths = [np.array([len(x) for x in v.bytes], np.int64) for v in (first, second)]
        db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        number = TaskContext.get().partitionId() << 32
        for ids, texts in _batches(record_batches, most):
            tokens = [v.encode([v.prefix + t for t in texts]) for v in (first, second)]
            good = [x and y for x, y in zip(*[come_back(texts, t, v) for v, t in zip((first, second), tokens, strict=True)], strict=True)]
            tokens = [[x if ok else [] for x, ok in zip(t, good, strict=True)] for t in tokens]
            out = align_batch(db, *tokens, *lengths)
            groups = [g if spelled or not g else hashlib.sha256(g.encode()).hexdigest() for g in out.groups]
            cuts = np.searchsorted(out.held["doc"], np.arange(len(texts) + 1)).astype(np.int32)
            lists = {"pair": pa.ListArray.from_arrays(cuts, pa.array(out.held["pair"], pa.int32())), "n": pa.ListArray.from_arrays(cuts, pa.array(out.held["n"], pa.int32()))}
            numbers = {k: pa.array(getattr(out, k), pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")}
            rows = {"batch": pa.array([number] * len(texts)), "place": pa.array(range(len(texts)), pa.int32()), "id": ids, "groups": pa.array(groups, pa.string())} | numbers | lists
            total = {"batch": pa.array([number])} | {k: pa.array([v], pa.list_(pa.int32())) for k, v in out.pairs.items()}
            for columns, n in ((rows, len(texts)), (total, 1)):
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)
            number += 1

    return documents.mapInArrow(run, kind)


def pair_counts(batches: DataFrame) -> DataFrame:
    """a, b, n: the links of each pair of ids in all batches, and ``best``, whether no other id of A meets this id of B more often."""
    partial = batches.where("place is null").select(F.inline(F.arrays_zip("a", "b", "n")))
    counts = partial.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(batches: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of the batches with n_best and count_sum, by the counts of the pairs that a batch holds."""
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups"]
    docs = batches.where("place is not null").select("batch", *names, "pair", "n")
    own = batches.where("place is null").select(F.col("batch").alias("holder"), F.posexplode(F.arrays_zip("a", "b")).alias("pair", "ids"))
    known = own.select("holder", "pair", "ids.a", "ids.b").join(counts, ["a", "b"]).select("holder", "pair", "n", "best")
    kind = docs.select(*names).schema.add("n_best", T.LongType()).add("count_sum", T.LongType())

    def score(rows, lookup):
        import pyarrow as pa

        size = lookup.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[np.asarray(lookup["pair"])], best[np.asarray(lookup["pair"])] = np.asarray(lookup["n"]), np.asarray(lookup["best"])
        out = rows.select(names)
        pairs, n = rows["pair"].combine_chunks(), np.asarray(rows["n"].combine_chunks().flatten(), np.int64)
        pair, ends = np.asarray(pairs.flatten()), np.r_[0, np.cumsum(np.asarray(pairs.value_lengths(), np.int64))]
        for values in (best, count):
            sums = np.r_[0, np.cumsum(n * values[pair])][ends]
            out = out.append_column(kind.names[out.num_columns], pa.array(np.diff(sums), pa.int64()))
        return out

    return docs.groupBy("batch").cogroup(known.groupBy("holder")).applyInArrow(score, kind)


def align(documents: DataFrame, a: Callable[[], Vocabulary], b: Callable[[], Vocabulary], spelled: bool = False, text: str = "text", id: str = "doc_id", batch: int = BATCH) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum.

    A link is a token of A and one of B whose byte ranges overlap; a group ends where tokens of both end. ``groups`` spells out
    the ids as ``a1,a2|b1;a3|b2,b3`` if ``spelled``, else it is the SHA-256 of that. ``count_sum`` adds the corpus-wide links of each link's
    pair of ids, ``n_best`` counts the links whose pair no other id of A beats, ties included. Null and empty texts, and those
    whose tokens do not give their bytes back, have no tokens: zeros and an empty ``groups``. Repeated rows each count and give
    a row; an empty table gives none; other columns are left out, whatever their names. Memory is bounded by ``batch``
    characters, or one text.
    """
    rows = documents.select(documents[id].alias("id"), text_of(documents, text).alias("text"))
    batches = written(aligned_batches(rows, a, b, spelled, batch))
    return scored(batches, written(pair_counts(batches))).withColumnRenamed("id", id)
