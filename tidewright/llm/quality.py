"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is linear in the number of features: the pairwise term is half of the sum over factors of the square of the sum
less the sum of the squares. The machine is fitted on a bounded sample of labelled rows; every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 4096
STATS = 18
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARKS = b".,;:?'\"()-"
_SYMBOLS = b"#$%&*@^~<>{}[]\\/_+="


def features(value: bytes | None, n_chars: int | None, seen: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and their values for one text; ``seen`` remembers word numbers between texts."""
    raw = value or b""
    words = raw.split()
    numbers = []
    for w in words:
        k = seen.get(w)
        if k is None:
            if len(seen) >= 50_000:
                seen.clear()
            k = seen[w] = crc32(w.lower()) % WORDS
        numbers.append(k)
    counts = np.bincount(np.array(numbers, np.int64), minlength=WORDS)
    at = np.flatnonzero(counts)
    tf = np.log1p(counts[at])
    tf /= max(1e-9, float(np.sqrt((tf * tf).sum())))
    n, k = max(1, len(raw)), max(1, len(words))
    lines = raw.split(b"\n")
    share = lambda kind, gain=1.0: min(1.0, gain * (len(raw) - len(raw.translate(None, kind))) / n)
    distinct = len(set(words))
    stats = np.array(
        [
            1.0,
            share(_UPPER, 3),
            share(_LOWER),
            share(_DIGIT, 5),
            share(_MARKS, 5),
            share(_SYMBOLS, 10),
            share(b"|", 20),
            share(b"!", 10),
            share(b"\n", 20),
            share(bytes(range(128, 256)), 2),
            distinct / k,
            min(1.0, len(raw) / k / 20),
            min(1.0, max(map(len, words), default=0) / 100),
            np.log1p(len(words)) / 12,
            len(set(lines)) / max(1, len(lines)),
            min(1.0, sum(map(bytes.istitle, words)) / k),
            min(1.0, sum(map(bytes.isupper, words)) / k),
            np.log1p(max(0, n_chars if n_chars is not None else len(raw))) / 14,
        ]
    )
    return np.concatenate([at, WORDS + np.arange(STATS)]).astype(np.int32), np.concatenate([tf, stats]).astype(np.float32)


@dataclass
class FactorisationMachine:
    """Weights of the linear part and low-rank factors of the pairwise part, over WORDS + STATS features."""

    weights: np.ndarray
    factors: np.ndarray

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        s = v.sum(axis=0)
        z = float(self.weights[at] @ x) + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rank: int = 4, epochs: int = 8, rate: float = 0.1, batch: int = 128, decay: float = 1e-5) -> FactorisationMachine:
    """Logistic loss by Adagrad over mini-batches; without rows the factors stay small random numbers and the score near 0.5 (0.49 to 0.53)."""
    rng = np.random.default_rng(7)
    width = WORDS + STATS
    w, v = np.zeros(width), rng.normal(0, 0.05, (width, rank))
    gw, gv = np.full(width, 1e-6), np.full((width, rank), 1e-6)
    for _ in range(epochs if rows else 0):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part]).astype(float)
            sizes = np.array([len(rows[i][0]) for i in part])
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            of = np.repeat(np.arange(len(part)), sizes)
            xv = v[at] * x[:, None]
            s = np.add.reduceat(xv, first)
            z = np.add.reduceat(w[at] * x, first) + 0.5 * (s * s - np.add.reduceat(xv * xv, first)).sum(axis=1)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([rows[i][2] for i in part])) / len(part)
            dw, dv = np.bincount(at, e[of] * x, width), np.zeros_like(v)
            np.add.at(dv, at, (e[of] * x)[:, None] * (s[of] - xv))
            dw, dv = dw + decay * w, dv + decay * v
            gw += dw * dw
            gv += dv * dv
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return FactorisationMachine(w, v)


def held_out(id: Column) -> Column:
    """True for the fifth of ids that the classifier never learns from: crc32 of the id as text mod 5 is 0, or null id."""
    return F.coalesce(F.crc32(id.cast("string")) % 5 == 0, F.lit(True))


def train(documents: DataFrame, labels: DataFrame, sample_rows: int = 8000, text: str = "text", id: str = "doc_id", chars: str = "n_chars") -> FactorisationMachine:
    """A machine fitted on at most ``sample_rows`` labelled documents that are not held out, chosen by hash of the id.

    The bound is the limit of a sampling operator: only these rows' features (at most WORDS + STATS each) reach the driver.
    Ids with several labels count by their mean, of rows with one id one counts; rows with a null label or id are left out.
    """
    chosen = (
        labels.where(labels["quality"].isNotNull() & ~held_out(labels[id]))
        .groupBy(labels[id].alias("id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )

    @F.arrow_udf("binary")
    def packed(texts, lengths):
        import pyarrow as pa

        seen: dict[bytes, int] = {}
        pairs = zip(texts.cast(pa.binary()), lengths, strict=True)
        return pa.array([b"".join(a.tobytes() for a in features(t.as_py(), n.as_py(), seen)) for t, n in pairs], pa.binary())

    texts = documents.select(documents[id].alias("id"), documents[text].cast("string").alias("text"), documents[chars].cast("long").alias("chars"))
    one = F.min_by(F.struct("text", "chars"), F.struct(F.xxhash64("text"), "chars")).alias("d")
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(one).select("id", "y", packed(F.col("d.text"), F.col("d.chars")).alias("features"))
    rows = sorted((r["id"], bytes(r["features"]), r["y"]) for r in sample.toLocalIterator())
    half = lambda b: len(b) // 2
    return fit([(np.frombuffer(b[: half(b)], np.int32), np.frombuffer(b[half(b) :], np.float32), y) for _, b, y in rows])


def score(text: Column, n_chars: Column, model: FactorisationMachine) -> Column:
    """Probability of good quality, from the whole text and its length alone; null texts score as empty ones."""
    small = FactorisationMachine(model.weights.astype(np.float32), model.factors.astype(np.float32))

    @F.arrow_udf("double")
    def of(texts, lengths):
        import pyarrow as pa

        seen: dict[bytes, int] = {}
        pairs = zip(texts.cast(pa.binary()), lengths, strict=True)
        return pa.array([small.score(*features(t.as_py(), n.as_py(), seen)) for t, n in pairs], pa.float64())

    return of(text.cast("string"), n_chars.cast("long"))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", id: str = "doc_id", chars: str = "n_chars", **parameters) -> DataFrame:
    """Every row's id, held_out, score and predicted (1 if the score reaches the threshold).

    Null ids are held out; null and empty texts are scored by their structure; repeated rows each get a row; an empty
    table gives an empty result; other columns are left out.
    """
    model = train(documents, labels, text=text, id=id, chars=chars, **parameters)
    rows = documents.select(documents[id].alias(id), held_out(documents[id]).alias("held_out"), score(documents[text], documents[chars], model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", chars: str = "n_chars", **parameters) -> DataFrame:
    """The rows of documents that the classifier does not reject, with their columns, whatever their names.

    Null and empty texts are scored by their structure; null ids, repeated rows and equal scores make no difference; an empty
    table gives an empty result; without labels every score is near 0.5 and all rows stay.
    """
    model = train(documents, labels, text=text, chars=chars, **parameters)
    return documents.where(score(documents[text], documents[chars], model) >= threshold)
