"""Ways to say values, read back by the number reader, and loose matching case by case."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewright.functions import speech, spoken
from tidewright.functions.numerals import chinese_value, numbers_in


def test_chinese_readings_are_read_back(spark):
    numbers = [*range(0, 330), 1000, 1001, 1010, 1100, 1500, 2002, 2222, 9999, 10_000, 10_001, 10_010, 20_000, 22_020, 120_105, 1_010_101, 20_000_000, 99_999_999, 100_000_000, -1]
    out = {r["n"]: r["f"] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", spoken.chinese_forms(F.col("n")).alias("f")).collect()}
    assert out[-1] == out[100_000_000] == []
    for n in numbers[:-2]:
        assert out[n] and all(chinese_value(f) == n for f in out[n]), (n, out[n])
    assert set(out[180]) == {"一百八十", "一百八"} and set(out[2]) == {"二", "两"} and out[12] == ["十二"] and out[20] == ["二十"] and set(out[1500]) == {"一千五百", "一千五"}


def test_spoken_money_is_read_back(spark):
    cents = [0, 5, 50, 180, 200, 1250, 123_450, 99_999, 1_234_500]
    out = {r["n"]: r["f"] for r in spark.createDataFrame([(n,) for n in cents], "n long").select("n", spoken.spoken_forms(F.col("n")).alias("f")).collect()}
    assert {"1.8", "1.80", "1块8", "一块八", "180", "一百八十"} <= set(out[180]) and {"12.5", "12.50", "1,250"} <= set(out[1250]) and "1,234.50" in out[123_450]
    for n in cents:
        for form in out[n]:
            assert {float(n), n / 100} & set(numbers_in(form)), (n, form)


@pytest.mark.parametrize(
    ("text", "value", "kind", "want"),
    [
        ("it costs $1,234.50 now", "123450", "integer", True), ("it costs 1234.5", "123450", "integer", True), ("code 91234.5", "123450", "integer", False), ("Twelve offers", "12", "integer", True), ("twelveteen", "12", "integer", False),
        ("about 15% off", "0.15", "number", True), ("0.15 off", "0.15", "number", True), ("115% off", "0.15", "number", False), ("roughly 3.14 or so", "3.14159", "number", True), ("3.1", "3.14159", "number", True), ("3.2", "3.14159", "number", False),
        ("at 3:30 p.m. sharp", "15:30", "time", True), ("at 3 PM", "15:00", "time", True), ("at 3:30 am", "15:30", "time", False), ("at 12:05 am", "00:05", "time", True), ("due March 5", "2024-03-05", "date", True), ("due March 6", "2024-03-05", "date", False),
        ("The BLUE-hat!", "blue hat", "string", True), ("the red hat", "blue hat", "string", False), ("anything", "!!", "string", False), ("true", "true", "boolean", False), ("x", None, "string", False), (None, "x", "string", False), ("", "0", "integer", False),
    ],
)
def test_said_loosely(spark, text, value, kind, want):
    frame = spark.createDataFrame([(text, value, kind)], "t string, v string, k string").withColumn("s", speech.stated(F.col("t")))
    assert frame.select(spoken.said_loosely(F.col("t"), F.col("s"), F.col("v"), F.col("k")).alias("x")).first()["x"] is want
