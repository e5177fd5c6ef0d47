"""The numbers that a text states, read from digits, percentages, English words and Chinese numerals.

A text is read once into an array of numbers; whether it says a number is then a test on that array in Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and signs for numbers.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
TENS = {"thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
WORDS = {w: i for i, w in enumerate(ONES)} | TENS
SIGNS = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10_000}

_DIGITS = re.compile(r"(?<![\d.])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?![\d])")
_PERCENT = re.compile(r"(?<![\d.])(\d+(?:\.\d+)?)\s*(?:%|percent|个百分点)", re.IGNORECASE)
_WORD = re.compile(r"\b(" + "|".join(WORDS) + r")\b", re.IGNORECASE)
_CHINESE = re.compile("[零一二两三四五六七八九十百千万]+")
_YUAN = re.compile(r"(\d+|[零一二两三四五六七八九十百千万]+)块(\d|[零一二两三四五六七八九])(?![\d十百千万])")


def chinese_value(text: str) -> int | None:
    """The value of a Chinese numeral below 10**8, a trailing sign taking the unit below the last; null if it is none.

    A unit counts the sign before it: 百, 千 and 万 are no numbers by themselves, 十 only at the beginning is.
    """
    total, part, sign, last = 0, 0, None, 1
    for at, c in enumerate(text):
        if c in SIGNS:
            if sign is not None and sign != 0:
                return None
            sign = SIGNS[c]
            if sign == 0:
                last = 10
        elif not sign and (UNITS[c] < 10_000 or not part) and not (c == "十" and at == 0):
            return None
        elif UNITS[c] == 10_000:
            total, part, sign, last = (part + (sign or 0)) * 10_000, 0, None, 10_000
        else:
            part, last, sign = part + (1 if sign is None else sign) * UNITS[c], UNITS[c], None
    if sign:
        part += sign * (last // 10 if last >= 100 else 1)
    return total + part


def numbers_in(text: str) -> list[float]:
    """Distinct numbers stated in a text, sorted; shares as percentages count by their share too."""
    found: set[float] = {float(m[1].replace(",", "")) for m in _DIGITS.finditer(text)}
    found |= {float(m[1]) / 100 for m in _PERCENT.finditer(text)}
    found |= {float(WORDS[m[1].lower()]) for m in _WORD.finditer(text)}
    found |= {float(v) for m in _CHINESE.finditer(text) if (v := chinese_value(m[0])) is not None}
    for m in _YUAN.finditer(text):
        whole = int(m[1]) if m[1].isdigit() else chinese_value(m[1])
        if whole is not None:
            found.add(whole + (int(m[2]) if m[2].isdigit() else SIGNS[m[2]]) / 10)
    return sorted(round(x, 9) for x in found)


def stated_numbers(text: Column) -> Column:
    """numbers_in as a column; an empty array for null."""

    @F.arrow_udf("array<double>")
    def of(values):
        import pyarrow as pa

        return pa.array([numbers_in(v) if v else [] for v in values.to_pylist()], pa.list_(pa.float64()))

    return of(text)


def says(numbers: Column, value: Column) -> Column:
    """Whether the stated numbers hold a value: itself, its size if negative, or a whole number of cents as units."""
    size = F.abs(value.cast("double"))
    whole = size == F.floor(size)
    near = lambda target: F.exists(numbers, lambda x: F.abs(x - target) < 1e-9)
    return near(size) | (whole & near(size / 100))
