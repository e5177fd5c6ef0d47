"""Alignment of tokenizers, runs of words and token counts against plain code and the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewright.llm import alignment, queries, runs, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(6, 4 * p) and not any(w[i : i + length - q] == w[i + q : i + length] for q in range(1, p)):
                out.append((i, length, p))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(w: list, found: list) -> str:
    dropped = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in dropped)


def test_op12_runs_equal_a_plain_search():
    rng = random.Random(2)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 45), rng.randint(0, 3)
            w = [rng.randint(0, k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randint(0, n - 1), rng.randint(1, max(1, n // 4))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        first = np.r_[0, np.cumsum([len(d) for d in docs])]
        got = runs.find_runs(np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
        assert [tuple(r) for r in got.tolist()] == [(int(first[k]) + s, n, p) for k, d in enumerate(docs) for s, n, p in plain_runs(d)]


def test_op12_on_documents(spark):
    """Every document, with the tails that the contract repeats, against plain code."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").toPandas()
    out = queries.op12_runs(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    assert sorted(out.index) == sorted(docs.doc_id)
    seen = 0
    for r in docs.itertuples():
        w = r.text.split()
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        words = {x: k for k, x in enumerate(dict.fromkeys(w))}
        ids = [words[x] for x in w]
        found = [tuple(x) for x in runs.find_runs(np.array(ids, np.int64), np.zeros(n, np.int64)).tolist()]
        if n <= 800:
            assert found == plain_runs(ids)
        got = out.loc[r.doc_id]
        seen += len(found)
        assert got.n_runs == len(found)
        assert got.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(plain_collapse(w, found).encode()).hexdigest()
        if found:
            s, m, p = min(found, key=lambda x: (-x[1], x[0], x[2]))
            assert (got.start, got.length, got.period, got.exponent_milli) == (s, m, p, 1000 * m // p)
        else:
            assert np.isnan(got.start)
    assert seen > 10


def test_op12_awkward(spark, awkward, nothing, monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 7)  # pieces of few documents, and single long ones
    docs = awkward.unionByName(spark.createDataFrame([(20, "a b " * 5 + "c c c c c c", "x" * 7), (21, "z z z z z", "")], "doc_id long, text string, lang string"), allowMissingColumns=True)
    out = runs.collapse(docs).collect()
    assert len(out) == awkward.count() + 2
    by = {r["doc_id"]: r for r in out}
    assert [(r["start"], r["length"], r["period"]) for r in by[20]["runs"]] == [(0, 10, 2), (10, 6, 1)] and by[20]["collapsed"] == "a b c"
    assert by[21]["runs"] == [] and by[21]["collapsed"] == "z z z z z"
    assert [by[i]["collapsed"] for i in (3, 4, 6, 7)] == ["", "", "", "one"] and by[None]["collapsed"] == "no id at all"
    assert [tuple(r) for r in by[5]["runs"]] == [(0, 30_000, 997)] and len(by[5]["collapsed"].split()) == 997
    assert runs.collapse(nothing).count() == 0
    assert runs.collapse(awkward, words=F.lit(None).cast("array<string>")).where("collapsed = '' and size(runs) = 0").count() == awkward.count()


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def strange_texts(pieces, count: int, seed: int = 5) -> list[str]:
    rng, names = random.Random(seed), [pieces.id_to_piece(i) for i in range(259, 32000)]
    out = ["", " ", "  ", "▁", "\0", "<s> </s><unk><0x41>", "a" * 5000, " " * 3000, "\n" * 999, "漢字" * 900]
    while len(out) < count:
        kind = rng.randrange(6)
        if kind == 0:
            t = "".join(rng.choice(" ab") for _ in range(rng.randint(0, 60)))
        elif kind == 1:
            t = "".join(rng.choice(names).replace("▁", " ") for _ in range(rng.randint(0, 20)))
        elif kind == 2:
            t = "".join(rng.choice("thein aor") for _ in range(rng.randint(0, 60)))
        elif kind == 3:
            t = "".join(chr(rng.choice([rng.randrange(0x300), rng.randrange(0x4E00, 0x9000), rng.randrange(0x1F300, 0x1F700), 32, 9, 10])) for _ in range(rng.randint(0, 40)))
        elif kind == 4:
            t = "".join(rng.choice(names)[: rng.randint(1, 4)] for _ in range(rng.randint(0, 20)))
        else:
            t = rng.choice(["<s>", "</s>", "<0x41>", " ", "  ", "é", "▁", "\n\n", "000"]) * rng.randint(0, 30) + rng.choice(names)
        out.append(t)
    return out


def test_op13_equals_the_library(pieces):
    """Texts of pieces, of their parts, of any characters and of runs of white space, cut into chunks of any size."""
    machine, rng = token_counts.piece_transducer(PIECES), random.Random(1)
    for t in strange_texts(pieces, 3000):
        size = rng.choice([1, 2, 5, 40, 4096])
        chunks = [t[k : k + size] for k in range(0, len(t), size)]
        assert machine.count([" " + c if k == 0 else c for k, c in enumerate(chunks)]) == len(pieces.encode(t)), t


def test_op13_survives_a_full_table(pieces):
    small = token_counts.Transducer(dict(token_counts.piece_transducer(PIECES).scores), limit=50)
    texts = strange_texts(pieces, 200, 8)[11:]
    assert [small.count([" " + t]) if t else 0 for t in texts] == [len(x) for x in pieces.encode(texts)]


def test_op13_prefix_scan_composes_in_order():
    machine = token_counts.piece_transducer(PIECES)
    text = " the aaaaaaaaaaaaaaaaaaaaaaabbbbbbabababa quick" * 3
    chunks = [text[k : k + 3] for k in range(0, len(text), 3)]
    state, total = machine.start, 0
    for scanned, chunk in zip(token_counts.prefix_scan(machine.state_maps(chunks)), chunks, strict=True):
        state, n = machine.run(state, chunk)
        total += n
        assert scanned[machine.start] == (state, total)


def test_op13_on_documents(spark, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    out = queries.op13_token_counts(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id").loc[docs.doc_id]
    n = [len(x) for x in pieces.encode(docs.text.tolist())]
    assert out.n_tokens.tolist() == n and out.over_limit.tolist() == [x > 4096 for x in n]
    assert out.n_bytes.tolist() == [len(t.encode()) for t in docs.text]


def test_op13_awkward(spark, awkward, nothing, pieces):
    out = token_counts.count_tokens(awkward, PIECES, limit=3).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == sorted(
        (str(r["doc_id"]), len((r["text"] or "").encode()), n := len(pieces.encode(r["text"] or "")), n > 3) for r in awkward.collect()
    )
    assert token_counts.count_tokens(nothing, PIECES).count() == 0


BYTES = public_tokenizers.path("byte_bpe_50k.json")
BOTH = (lambda: alignment.byte_level(BYTES)), (lambda: alignment.sentence_pieces(PIECES))


def libraries_tokens(texts: list[str], pieces) -> list[tuple[list, list]]:
    """(id, bytes) of A and B by the tokenizers' own libraries, none where a text does not come back."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    letters = {c: b for c, b in alignment.byte_alphabet().items()}
    assert set(letters) == set(ByteLevel.alphabet())
    out = []
    for t in texts:
        a = [(i, bytes(letters[c] for c in own.id_to_token(i))) for i in own.encode(" " + t, add_special_tokens=False).ids]
        b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(t)]
        whole = (" " + t).encode()
        out.append((a, b) if t and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], []))
    return out


def plain_alignment(texts: list[str], pieces) -> list[tuple]:
    docs, counts, most = [], Counter(), Counter()
    for a, b in libraries_tokens(texts, pieces):
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e]
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[[i for i, s, _ in side if low <= s < high] for side in spans] for low, high in zip([0, *ends], ends, strict=False)]
        docs.append((len(a), len(b), len(ends), links, ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)))
        counts.update(links)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(na, nb, ng, len(ls), text, sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls)) for na, nb, ng, ls, text in docs]


@pytest.mark.parametrize("batch", [40, 2_000_000])
def test_op11_equals_plain_code(spark, pieces, batch):
    """Documents and strange texts, in batches of any size; ties of best pairs and texts that do not come back included."""
    docs = [r["text"][:400] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = docs + strange_texts(pieces, 60)[:5] + strange_texts(pieces, 90)[10:] + docs[:3] + ["▁ x", "<|endoftext|> y", "\0"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(frame, *BOTH, spelled=True, batch=batch).collect()}
    want = plain_alignment(texts, pieces)
    for k in range(len(texts)):
        assert out[k] == want[k], texts[k]
    assert want[len(texts) - 3][0] == 0 and want[len(texts) - 2][0] > 0


def test_op11_encodes_as_the_library(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BYTES)
    own.encode_special_tokens = True
    texts = [" " + r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + [" " * 1_000_000, " <|endoftext|>"]
    assert [list(x) for x in alignment.byte_level(BYTES).encode(texts)] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_op11_on_documents(spark, pieces):
    """Digests of the query, whose documents are whole."""
    out = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_alignment(spark, "/root/testdata/sf0.001").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect()}
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    lengths = [(len(a), len(b)) for a, b in libraries_tokens([r["text"] for r in rows], pieces)]
    assert sorted(out) == sorted(r["doc_id"] for r in rows)
    for r, n in zip(rows, lengths, strict=True):
        got = out[r["doc_id"]]
        assert got[:2] == n and (len(got[4]) == 64) == (n[0] > 0) and got[3] >= max(n) and got[2] <= min(n)


def test_op11_awkward(spark, awkward, nothing, pieces):
    got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in alignment.align(awkward.where("doc_id is null or doc_id <> 5"), *BOTH, spelled=True).collect())
    rows = [r for r in awkward.collect() if r["doc_id"] != 5]
    assert got == sorted((str(r["doc_id"]), *x) for r, x in zip(rows, plain_alignment([r["text"] or "" for r in rows], pieces), strict=True))
    assert alignment.align(awkward, *BOTH).count() == awkward.count()
    assert alignment.align(nothing, *BOTH).count() == 0
