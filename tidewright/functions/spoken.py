"""Ways to say a value, as Spark expressions: Chinese and English numerals, money, shares, rounded numbers and clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.numerals import ONES, SIGNS, TENS
from tidewright.functions.scalars import loose
from tidewright.functions.speech import says_date

DIGITS = "".join(dict.fromkeys(c for c in SIGNS if c != "两"))
#: Texts of this kind hold no number, truth or null.
TEXTS = ("string", "date", "time", "datetime", "enum")


def _four(signs: Column) -> Column:
    """Four signs, most significant first, with their units and without idle zeros."""
    spelled = F.concat(*[x for k, unit in enumerate("千百十") for x in (F.substring(signs, k + 1, 1), F.lit(unit))], F.substring(signs, 4, 1))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(spelled, "零[千百十]", "零"), "零+", "零"), "^零|零$", "")


def chinese_forms(n: Column) -> Column:
    """Readings of a whole number from 0 below 10**8, none for others: 12 十二; 2 二, 两; 180 一百八十, 一百八."""
    n = n.cast("long")
    signs = F.translate(F.lpad(n.cast("string"), 8, "0"), "0123456789", DIGITS)
    high, low = F.floor(n / 10_000), n % 10_000
    ten_thousands = F.when(high > 0, F.concat(_four(F.substring(signs, 1, 4)), F.lit("万"), F.when((low > 0) & (low < 1000), "零").otherwise(""))).otherwise("")
    whole = F.regexp_replace(F.concat(ten_thousands, _four(F.substring(signs, 5, 4))), "^一十", "十")
    cut = F.when(F.regexp_like(whole, F.lit("[一二三四五六七八九][百千万][一二三四五六七八九][十百千]$")), F.regexp_replace(whole, ".$", ""))
    forms = F.array_compact(F.array(whole, cut))
    pair = F.filter(forms, lambda f: f.startswith("二") & ((n < 10) | ~f.startswith("二十")))
    all_forms = F.concat(forms, F.transform(pair, lambda f: F.concat(F.lit("两"), F.substring(f, 2, 40))))
    none = F.expr("cast(array() as array<string>)")
    return F.when(n == 0, F.array(F.lit("零"))).when((n > 0) & (n < 10**8), all_forms).otherwise(none)


def english_form(n: Column) -> Column:
    """The English word of 0 to 20 and of whole tens to 90, else null."""
    words = {i: w for i, w in enumerate(ONES)} | {v: w for w, v in TENS.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), n.cast("int"))


def general(x: Column) -> Column:
    """A number with six significant digits, ties to even, and no idle zeros, below a million; null beyond, where an exponent would stand."""
    size = F.abs(x.cast("double"))
    before = F.when(size >= 1, F.floor(F.log10(size)) + 1).otherwise(0)
    even = lambda k: F.format_string(f"%.{6 - k}f", F.bround(x.cast("double"), 6 - k))
    shown = F.coalesce(*[F.when(before == k, even(k)) for k in range(6)], even(6))
    plain = F.when(shown.contains("."), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
    return F.when(size == 0, "0").when((size < 1_000_000) & (size >= 1e-4), plain)


def _grouped(x: Column, decimals: int) -> Column:
    return F.format_number(x, decimals)


def whole_forms(n: Column) -> Column:
    """How digits say a whole number: itself, with commas, and as cents of a unit with as many decimals as needed, with two, and with both."""
    units = n.cast("double") / 100
    return F.array_compact(F.array(general(n), _grouped(n.cast("long"), 0), general(units), F.format_string("%.2f", units), _grouped(units, 2)))


def spoken_forms(n: Column) -> Column:
    """All ways to say a whole number, sorted: digits, Chinese numerals, and cents in 元 such as 1块8 or 一块八."""
    n = n.cast("long")
    whole, cents = F.floor(n / 100), F.pmod(n, F.lit(100))
    tenth = F.floor(cents / 10)
    money = F.when(cents == 0, chinese_forms(whole)).when(
        cents % 10 == 0, F.concat(F.transform(chinese_forms(whole), lambda w: F.concat(w, F.lit("块"), F.substring(F.lit(DIGITS), (tenth + 1).cast("int"), F.lit(1)))), F.array(F.concat_ws("块", whole, tenth)))
    )
    return F.array_sort(F.array_distinct(F.concat(whole_forms(n), chinese_forms(n), F.coalesce(money, F.expr("cast(array() as array<string>)")))))


def _alternatives(forms: Column, before: str, after: str) -> Column:
    quoted = F.transform(forms, lambda f: F.regexp_replace(f, r"([^\p{L}\p{N}])", r"\\$1"))
    return F.concat(F.lit(f"{before}(?:"), F.array_join(quoted, "|"), F.lit(f"){after}"))


def said_loosely(text: Column, stated: Column, value: Column, kind: Column) -> Column:
    """Whether a text says a value in some form, whatever is around it; false for truths, nulls and empty texts.

    Numbers (``kind`` integer or number): digits, rounded to two places or one, whole numbers also with commas, as cents and
    as English words to twenty, shares below 1 as a percentage; none inside a longer number. Texts: a date in any form, a
    clock time also on the twelve-hour clock, else up to case, spaces and marks. ``stated`` is what ``speech.stated`` reads.
    """
    low, number = F.lower(F.coalesce(text, F.lit(""))), value.try_cast("double")
    whole = kind == "integer"
    rounded = [general(F.round(number, 2)), general(F.round(number, 1))]
    share = F.when(~whole & (number < 1), F.concat(general(number * 100), F.lit("%")))
    none = F.expr("cast(array() as array<string>)")
    digits = F.array_compact(F.concat(F.array(general(number), share, *rounded), F.when(whole, whole_forms(number)).otherwise(none)))
    signed = F.filter(digits, lambda f: ~F.regexp_like(f, F.lit("^[0-9]")))
    plain = F.filter(digits, lambda f: F.regexp_like(f, F.lit("^[0-9]")))
    word = F.when(whole & number.between(0, 20), english_form(number))
    words = F.array_compact(F.concat(signed, F.array(word)))
    hit = lambda forms, before, after: (F.size(forms) > 0) & F.regexp_like(low, _alternatives(forms, before, after))
    counted = hit(plain, r"(?<![\d.])", r"(?!\d)") | hit(words, r"\b", r"\b")
    hour = F.regexp_extract(value, r"^\s*(\d{1,2}):\d{2}\s*$", 1).try_cast("int")
    minute = F.regexp_extract(value, r"^\s*\d{1,2}:(\d{2})\s*$", 1)
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
    half = F.when(hour >= 12, "pm").otherwise("am")
    clock = F.concat(F.lit(r"\b"), twelve, F.when(minute == "00", F.concat(F.lit("(?::"), minute, F.lit(")?"))).otherwise(F.concat(F.lit(":"), minute)), F.lit(r"\s*"), half, F.lit(r"\b"))
    on_clock = hour.isNotNull() & F.regexp_like(F.replace(low, F.lit("."), F.lit("")), F.coalesce(clock, F.lit("$^")))
    key = loose(value)
    contained = (key != "") & F.contains(loose(low), key)
    text_said = says_date(stated, value) & F.regexp_like(value, F.lit(r"^\s*\d{4}-\d{2}-\d{2}")) | on_clock | contained
    return F.coalesce(F.when(kind.isin("integer", "number"), counted).when(kind.isin(*TEXTS), text_said), F.lit(False))
