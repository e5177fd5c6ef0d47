"""What a speech says: its dates and clock times, read once into canonical arrays, and texts up to typography."""

from __future__ import annotations

import re
import unicodedata
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.numerals import says, stated_numbers

# Names of months, and words for halves of the day.
MONTHS = "january february march april may june july august september october november december".split()
NUMBER = {name: i for i, name in enumerate(MONTHS, 1)} | {name[:3]: i for i, name in enumerate(MONTHS, 1)} | {"sept": 9}
LATE, EARLY = ("下午", "晚上", "傍晚", "中午"), ("上午", "早上", "凌晨", "早晨")

_NAMES = "|".join(sorted(NUMBER, key=len, reverse=True))
_DATES = [
    (re.compile(r"(?<!\d)(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?!\d)"), "ymd"),
    (re.compile(rf"\b({_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?!\d)(?:,?\s*(\d{{4}}))?", re.IGNORECASE), "Mdy"),
    (re.compile(rf"(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({_NAMES})\b\.?(?:,?\s*(\d{{4}}))?", re.IGNORECASE), "dMy"),
    (re.compile(r"(?<![\d/])(\d{1,2})/(\d{1,2})(?:/(\d{4}|\d{2}))?(?![\d/])"), "mdy"),
    (re.compile(r"(?:(\d{4})\s*年\s*)?(?<!\d)(\d{1,2})\s*月\s*(\d{1,2})\s*[日号]"), "ymd"),
]
_TWELVE = re.compile(r"(?<![\d:])(\d{1,2})(?::(\d{2}))?(?::00)?\s*([ap])\.?\s*m\b", re.IGNORECASE)
_CLOCK = re.compile(r"(?<![\d:])(\d{1,2}):(\d{2})(?!\d)(?!\s*[ap]\.?\s*m)", re.IGNORECASE)
_DIAN = re.compile(rf"({'|'.join(LATE + EARLY)})?\s*(?<!\d)(\d{{1,2}})\s*点\s*(?:(半)|(\d{{1,2}})\s*分|整)?(?!\s*\d)")


def dates_in(text: str) -> list[str]:
    """Days said, as YYYY-MM-DD, with the year 0000 where none was said. Only "May" is that month, "may" and "MAY" are not."""
    out = set()
    for pattern, order in _DATES:
        for m in pattern.finditer(text):
            part = dict(zip(order, m.groups(), strict=True))
            name = part.get("M")
            if name and name.lower() == "may" and name != "May":
                continue
            month = NUMBER[name.lower()] if name else int(part["m"])
            year = int(part["y"] or 0)
            year += 2000 if 0 < year < 100 else 0
            try:
                date(year or 2000, month, int(part["d"]))
            except ValueError:
                continue
            out.add(f"{year:04d}-{month:02d}-{int(part['d']):02d}")
    return sorted(out)


def times_in(text: str) -> list[str]:
    """Clock times said, as HH:MM; a bare hour before 点 is the morning's, an early twelve is midnight as well as noon."""
    out = set()
    for m in _TWELVE.finditer(text):
        if 1 <= int(m[1]) <= 12 and int(m[2] or 0) < 60:
            out.add(f"{int(m[1]) % 12 + 12 * (m[3].lower() == 'p'):02d}:{int(m[2] or 0):02d}")
    out |= {f"{int(m[1]):02d}:{m[2]}" for m in _CLOCK.finditer(text) if int(m[1]) < 24 and int(m[2]) < 60}
    for m in _DIAN.finditer(text):
        hour = int(m[2])
        hour = hour % 12 + 12 if m[1] in LATE and hour <= 12 else hour
        minute = 30 if m[3] else int(m[4] or 0)
        if m[1] in EARLY and hour == 12 and minute < 60:
            out.add(f"00:{minute:02d}")
        if hour < 24 and minute < 60:
            out.add(f"{hour:02d}:{minute:02d}")
    return sorted(out)


def stated(text: Column) -> Column:
    """dates, times and key (compatibility form, case folded) of a text."""

    @F.arrow_udf("struct<dates:array<string>,times:array<string>,key:string>")
    def of(values):
        import pyarrow as pa

        rows = [{"dates": dates_in(v or ""), "times": times_in(v or ""), "key": unicodedata.normalize("NFKC", v or "").casefold()} for v in values.to_pylist()]
        return pa.array(rows, pa.struct([("dates", pa.list_(pa.string())), ("times", pa.list_(pa.string())), ("key", pa.string())]))

    return of(text)


def says_date(said: Column, value: Column) -> Column:
    """Whether the day of an ISO text was said, with its year or without one."""
    day = F.substring(F.trim(value), 1, 10)
    return F.array_contains(said["dates"], day) | F.array_contains(said["dates"], F.concat(F.lit("0000"), F.substring(day, 5, 6)))


def says_time(said: Column, value: Column) -> Column:
    return F.array_contains(said["times"], F.lpad(F.trim(value), 5, "0"))


def says_text(said: Column, value: Column) -> Column:
    """Whether a text was said up to case and spaces, and not inside a longer ASCII word."""
    letters = F.regexp_replace(F.lower(F.regexp_replace(value, r"(?U)\s+", "")), r"([^\p{L}\p{N}])", r"\\$1")
    spaced = F.regexp_replace(letters, r"(\\?.)(?=.)", r"$1\\s*")
    guard = lambda side, edge: F.when(F.regexp_like(letters, F.lit(edge)), side).otherwise("")
    pattern = F.concat(guard("(?<![a-z0-9])", "^[a-z0-9]"), spaced, guard("(?![a-z0-9])", "[a-z0-9]$"))
    return F.when(letters == "", False).otherwise(F.regexp_like(said["key"], pattern))


def verified(speech: Column, said: Column, kind: Column, value: Column) -> Column:
    """The value where the speech says it (numbers, dates, times, free texts), null where not; enums and booleans stay."""
    number = says(stated_numbers(speech), value.try_cast("double"))
    iso = F.regexp_like(value, F.lit(r"^\d{4}-\d{2}-\d{2}"))
    clock = F.regexp_like(value, F.lit(r"^\d{1,2}:\d{2}$"))
    text = F.when(iso, says_date(said, value)).when(clock, says_time(said, value)).otherwise(says_text(said, value))
    heard = F.when(kind.isin("enum", "boolean"), True).when(kind.isin("integer", "number"), number).otherwise(text)
    return F.when(F.coalesce(heard, F.lit(False)), value)
