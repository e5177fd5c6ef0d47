"""Scalar functions on text, numbers, JSON and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide how texts and identifiers are read.
REPORT = (
    r"(?im)(here'?s (the|a|your) (outcome|summary|picture|result|breakdown|overview)|处理结果如下|结果如下"
    r"|^\s*#{1,4} |\n\s*\*\*[^*\n]{2,40}\*\*\s*\n\s*[-•])"
)
ANNOUNCE = r"(?i)\b(let me (check|look|get|find|verify|pull|see)|i'll (check|look|get|find|pull)|i will (check|look|get|find))\b|我(来|先)?(查|看|核实)一下|稍等"
INTERNAL = r"[A-Za-z]+_[A-Za-z_]+|\d+\s*分(?!钟)|\b\d+\s*cents?\b"
ID_KEY = r"(?i)(^|_)(id|ids|ref|reference|number|no|code)$"
TOKEN = r"[A-Za-z0-9#][A-Za-z0-9#_.:-]{2,}"
MACHINE_ID = r"^(?:[a-z]{1,3}\d{1,4}|[a-z][a-z0-9]*(?:[-_][a-z0-9]+)+)$"
NUMERIC_TEXT = r"^[$¥￥]?-?\d{1,3}(,\d{3})*(\.\d+)?$|^[$¥￥]?-?\d+(\.\d+)?$"
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$"
RED_FLAGS_EN = {
    "amount in cents (users say dollars)": r"(?i)\b\d+\s*cents?\b",
    "dictates the confirmation protocol": r"(?i)\b(confirm|check) with me (first|before)|\bwait for my (ok|approval|confirmation)|\bbefore (each|every) (step|item|one)\b",
    "virtual clock": r"(?i)\b(current )?time (is )?\d+\b|\bday \d+\b|\bvirtual\b|time\.start",
    "transaction semantics": r"(?i)\batomic|\broll ?back\b",
}
RED_PHRASES_ZH = ("多少分", "别影响", "不影响已", "原子", "回滚", "都别扣", "一批都别", "一次办好", "有冲突的别", "有冲突的就不", "指定的", "操作前", "分别让我确认")
RED_FLAGS_ZH = {
    "金额用“分”（用户说“元”）": r"\d+\s*分(?![钟之])",
    "交代确认流程": r"先(告诉|跟|给|让|发)我.{0,12}(确认|看|过目)|等我(确认|点头|同意|回复)|我(确认|点头|同意)(了|后|之后|完)(你)?再|确认(后|之后|完)(你)?再|每(一)?(步|件|条|项|笔|个|次)[^，。；]{0,10}(之?前)?(都)?先",
    "虚拟时间": r"当前时间(是|为)?\s*\d+|第\s*\d+\s*(天|日)(?![内])|(时刻|时间点|时间)(是|为)?\s*\d+(?!\s*(分钟|小时|天|点|号|元|块))",
}
WRITE_WORDS = ("book", "update", "cancel", "send_certificate", "transfer", "modify", "exchange", "return")


def is_failure(content: Column) -> Column:
    """A failed tool result: a text that begins with Error, or a JSON object whose ok is false."""
    text = F.coalesce(content, F.lit(""))
    ok = F.try_variant_get(F.try_parse_json(text), "$.ok", "boolean")
    return text.startswith("Error") | F.coalesce(~ok, F.lit(False))


def is_failure_text(content: Column) -> Column:
    """The second of the failure rules: the substring ``"ok": false``, or a text that begins with Error."""
    text = F.coalesce(content, F.lit(""))
    return text.startswith("Error") | text.contains('"ok": false')


def canonical_map(values: Column) -> Column:
    """A flat map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spaces at every depth, other letters kept; null where it does not parse."""

    @F.arrow_udf("string")
    def of(values):
        import json

        import pyarrow as pa

        def one(v: str | None) -> str | None:
            try:
                return None if v is None else json.dumps(json.loads(v), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return pa.array([one(v) for v in values.to_pylist()], pa.string())

    return of(text)


def text_key(text: Column) -> Column:
    """Compatibility form, case folded, without white space: how free texts are compared."""

    @F.arrow_udf("string")
    def of(values):
        import unicodedata

        import pyarrow as pa

        return pa.array([None if v is None else "".join(unicodedata.normalize("NFKC", v).casefold().split()) for v in values.to_pylist()], pa.string())

    return of(text)


def ascii_key(text: Column) -> Column:
    """text_key for ASCII texts, in Spark only."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def number_of(text: Column) -> Column:
    """The number that a text states ("12.50", "$12.5", "1,250"), rounded to nine decimals; null if it states none."""
    trimmed = F.trim(text)
    digits = F.regexp_replace(trimmed, "[$¥￥,]", "")
    return F.when(F.regexp_like(trimmed, F.lit(NUMERIC_TEXT)), F.round(digits.try_cast("double"), 9))


def iso_moment(text: Column) -> Column:
    """Tagged canonical day or minute of an ISO text (``d:2024-05-31``, ``t:2024-05-31T18:00``); null for other texts."""
    trimmed = F.trim(text)
    stamp = F.try_to_timestamp(F.replace(trimmed, F.lit("T"), F.lit(" ")))
    shape = F.when(F.length(trimmed) == 10, F.concat(F.lit("d:"), F.date_format(stamp, "yyyy-MM-dd"))).otherwise(
        F.concat(F.lit("t:"), F.date_format(stamp, "yyyy-MM-dd'T'HH:mm"), F.when(F.second(stamp) > 0, F.date_format(stamp, ":ss")).otherwise(""))
    )
    return F.when(F.regexp_like(trimmed, F.lit(ISO_TEXT)) & stamp.isNotNull(), shape)


def normal_text(text: Column) -> Column:
    """Tagged normal form of a text: null, number, ISO moment or text key, as they are compared."""
    number = number_of(text)
    return (
        F.when(text.isNull(), "null:")
        .when(number.isNotNull(), F.concat(F.lit("n:"), number.cast("string")))
        .when(iso_moment(text).isNotNull(), iso_moment(text))
        .otherwise(F.concat(F.lit("s:"), ascii_key(text)))
    )


def is_calendar(text: Column) -> Column:
    """A real day, or day and minute, in the two fixed forms."""
    stamp = F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")))
    return F.coalesce(F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2})?$")) & stamp.isNotNull(), F.lit(False))


def shift(text: Column, minutes: Column) -> Column:
    """A calendar text moved by minutes, in its own form."""
    stamp = F.try_to_timestamp(F.replace(text, F.lit("T"), F.lit(" ")))
    moved = F.timestamp_add("MINUTE", minutes.cast("int"), stamp)
    return F.when(text.contains("T"), F.date_format(moved, "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format(moved, "yyyy-MM-dd"))


def quoted(quote: Column, *texts: Column) -> Column:
    """Whether a quote of at least four characters stands in one of the texts, white space apart."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    inside = [F.coalesce(flat(t).contains(flat(quote)), F.lit(False)) for t in texts]
    hit = inside[0]
    for x in inside[1:]:
        hit = hit | x
    return F.coalesce(F.length(flat(quote)) >= 4, F.lit(False)) & hit


def is_internal(value: Column, known: Column) -> Column:
    """A machine-looking identifier that stands in none of the known texts (an array)."""
    return F.coalesce(F.regexp_like(value, F.lit(MACHINE_ID)), F.lit(False)) & ~F.exists(known, lambda t: F.contains(t, value))


def red_flags(text: Column, language: str = "en") -> Column:
    """Sorted distinct labels of wording that a real user would not use."""
    rules = RED_FLAGS_EN if language == "en" else RED_FLAGS_ZH
    labels = [F.when(F.regexp_like(text, F.lit(p)), F.lit(label)) for label, p in rules.items()]
    if language != "en":
        labels += [F.when(text.contains(p), F.lit(p)) for p in RED_PHRASES_ZH]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))


def is_report(text: Column, limit: int = 600) -> Column:
    """A reply over a length limit or in the shape of a report."""
    body = F.coalesce(text, F.lit(""))
    return (F.length(body) > limit) | F.regexp_like(body, F.lit(REPORT))


def leaks_internals(text: Column) -> Column:
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit(INTERNAL))


def loose(text: Column) -> Column:
    """Digits, a-z and CJK only."""
    return F.regexp_replace(F.lower(text), r"[^0-9a-z一-鿿]", "")


def same_loosely(expected: Column, actual: Column) -> Column:
    """Numbers within 0.006 or half a percent, other texts equal after ``loose``."""
    a, b = number_of(expected), number_of(actual)
    near = F.abs(a - b) <= F.greatest(F.lit(0.006), F.abs(a) * 0.005)
    return F.when(a.isNotNull() & b.isNotNull(), near).otherwise(loose(expected) == loose(actual))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\W+", "_")


def fabricated(text: Column) -> Column:
    """Every digit moved by three."""
    return F.translate(text, "0123456789", "3456789012")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body, or a lambda inside it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_space(text: Column) -> Column:
    """A text without its white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def character_grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams without white space; the text itself where it is shorter."""

    def grams(c: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))
        return F.when(F.size(c) >= n, F.array_distinct(many)).otherwise(F.array(F.array_join(c, "")))

    return let(F.split(without_space(text), ""), grams)


def word_grams(text: Column, n: int = 8, pattern: str = r"(?U)\w+") -> Column:
    """Distinct lower-cased word n-grams; none for fewer words."""

    def grams(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        return F.when(F.size(words) >= n, F.array_distinct(many)).otherwise(F.expr("cast(array() as array<string>)"))

    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)), grams)


def word_gram_hashes(text: Column, n: int = 8, pattern: str = r"(?U)\w+") -> Column:
    """64-bit hashes of the lower-cased word n-grams, repeats included; none for fewer words."""
    hashes = lambda words: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(n)))))
    return let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0)), hashes)


def mix_of(text: Column) -> Column:
    """``a=0.1,b=0.9`` as a map of shares; null unless they add to 1."""
    shares = F.transform_values(F.str_to_map(F.regexp_replace(text, r"\s+", ""), F.lit(","), F.lit("=")), lambda _, v: v.try_cast("double"))
    total = F.aggregate(F.map_values(shares), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.abs(total - 1) < 1e-9, shares)


def task_shape(tool_calls: Column, writes: Column, depends: Column) -> Column:
    """The shape that a reference solution has: by its calls, its writes, and whether a call depends on a result."""
    return (
        F.when(tool_calls == 0, "direct")
        .when(writes > 1, "complex")
        .when(writes == 1, "single_write")
        .when(depends, "ordinary")
        .otherwise("simple")
    )


def clock_text(moment: Column, language: str = "en") -> Column:
    stamp = F.date_format(moment, "yyyy-MM-dd HH:mm")
    if language == "en":
        return F.concat(F.lit("Current time: "), stamp, F.lit(" ("), F.date_format(moment, "EEEE"), F.lit(")"))
    days = F.array(*[F.lit(f"星期{d}") for d in "日一二三四五六"])
    return F.concat(F.lit("当前时间："), stamp, F.lit("（"), F.element_at(days, F.dayofweek(moment)), F.lit("）"))


def is_peak(moment: Column) -> Column:
    """A weekday from 9 to 12 or from 14 to 18 in Beijing, for a UTC time."""
    there = F.from_utc_timestamp(moment, "Asia/Shanghai")
    hour = F.hour(there)
    return F.dayofweek(there).between(2, 6) & (((hour >= 9) & (hour < 12)) | ((hour >= 14) & (hour < 18)))


def seconds_to_switch(moment: Column) -> Column:
    """Seconds to the next change between peak and off-peak: within the day, or at nine on the next weekday."""
    there = F.from_utc_timestamp(moment, "Asia/Shanghai")
    hour, day = F.hour(there), F.dayofweek(there)
    weekday = day.between(2, 6)
    days = F.when(day == 6, 3).when(day == 7, 2).otherwise(1)
    at = F.when(weekday & (hour < 9), 9).when(weekday & (hour < 12), 12).when(weekday & (hour < 14), 14).when(weekday & (hour < 18), 18).otherwise(days * 24 + 9)
    passed = there.cast("double") - F.date_trunc("day", there).cast("double")
    return (at * 3600 - passed).cast("long")


def cjk_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[一-鿿]")) / F.greatest(F.length(text), F.lit(1))


def middle_cut(text: Column, limit: int, mark: str = "\n...\n") -> Column:
    """The text, its middle cut out where it is longer than ``limit``."""
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half)))).otherwise(text)


def is_write(name: Column) -> Column:
    """A tool name with a write word that does not hand over to a person."""
    words = "|".join(WRITE_WORDS)
    return F.regexp_like(name, F.lit(words)) & ~name.startswith("transfer_to_human")


def usd_words(cents: Column) -> Column:
    """Minor units as a dollar text."""
    return F.concat(F.lit("$"), F.format_number(cents / 100.0, 2))
