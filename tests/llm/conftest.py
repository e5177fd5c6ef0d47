from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "the same text here", "en", "a", 18), (2, "the same text here", "en", "b", 18), (2, "the same text here", "en", "b", 18), (3, "", "en", "a", 0), (4, None, None, None, None),
        (None, "no id at all", "en", "a", 12), (5, long, "en", "c", len(long)), (6, " \t\n ", "en", "", 4), (7, "one", "fr", "a", 3), (8, "héllo wörld ünïcode ß", "de", "é", 21), (9, "The Same text here", "en", "z", 18),
    ]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, DOCS)
    extras = ["id", "size", "h", "fp", "shard", "slot", "cell", "row", "range", "number", "score", "found", "base", "t", "count", "rank", "taken", "target", "term", "entry", "root", "__id"]
    return frame.withColumns({c: F.lit("x") for c in extras})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
