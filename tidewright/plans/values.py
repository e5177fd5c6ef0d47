"""Queries on column functions: names, dates, clocks, speech and texts made of the tables' values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.functions import speech, spoken
from tidewright.functions.numerals import says, stated_numbers
from tidewright.operators import augment, certify, grading
from tidewright.sources import tables as T


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and types as tool names: safe, fabricated, write or not, loose keys and internal identifiers."""
    p = T.table(spark, sf_dir, "part")
    tool = F.concat(F.when(F.col("p_size") % 3 == 0, "update_").when(F.col("p_size") % 3 == 1, "get_").otherwise("transfer_to_human_"), F.col("p_partkey"))
    return p.select(
        "p_partkey", S.safe_name(F.concat("p_name", F.lit("-"), "p_brand")).alias("safe"), S.fabricated(F.col("p_brand")).alias("fabricated"), S.is_write(tool).alias("writes"), S.loose(F.concat("p_name", F.lit(" #"), "p_size")).alias("loose"),
        S.is_internal(F.concat(F.lit("part_"), "p_partkey"), F.array(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("the part_"), "p_partkey")).otherwise("none"))).alias("internal"), augment.is_lookup(tool).alias("looks_up"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and minutes of orders: real or not, moved, and told as a clock."""
    o = _orders(spark, sf_dir)
    minute = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.substring("day", 1, 8), F.lit("31"))).when(F.col("o_orderkey") % 3 == 1, minute).otherwise(F.col("day"))
    return o.select("o_orderkey", S.is_calendar(text).alias("real"), S.shift(minute, F.lit(90)).alias("later"), S.shift(F.col("day"), F.lit(-1440)).alias("before"), S.clock_text(F.col("o_orderdate")).alias("clock"))


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether events fall into peak hours, and the seconds to the next change."""
    e = T.table(spark, sf_dir, "events")
    return e.select("event_id", S.is_peak(F.col("ts")).alias("peak"), S.seconds_to_switch(F.date_trunc("minute", "ts")).alias("seconds"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the start of a conversation's turn is quoted from its other turns' texts, white space apart."""
    c = T.table(spark, sf_dir, "conversations")
    first = c.where("turn = 0").select("conv_id", F.col("text").alias("request"))
    rows = c.join(first, "conv_id", "left")
    return rows.select("conv_id", "turn", S.quoted(F.concat(F.lit("  "), F.substring("text", 1, 12)), F.col("request")).alias("quoted"))


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes that add to one, and shapes of orders as reference solutions."""
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    mix = S.mix_of(F.concat(F.lit("easy = 0."), (k % 5 + 1), F.lit(", hard=0."), (k % 7 + 1)))
    shape = S.task_shape(k % 4, k % 3, k % 2 == 0)
    return o.select("o_orderkey", F.round(mix["easy"], 6).alias("easy"), shape.alias("shape"), certify.category_fits(F.when(k % 5 == 0, "direct_response").when(k % 5 == 1, "simple_agentic").otherwise("multi_step_agentic"), shape).alias("fits"))


def loose_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and priorities as answers written in other ways: equal loosely or not."""
    o = _orders(spark, sf_dir)
    near = F.format_number(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 1.004).otherwise(1.006), 2)
    words = F.when(F.col("o_orderkey") % 3 == 0, F.upper(F.replace("o_orderpriority", F.lit("-"), F.lit(" ")))).otherwise("LOW")
    return o.select("o_orderkey", S.same_loosely(F.round("o_totalprice", 2).cast("string"), near).alias("price"), S.same_loosely(F.col("o_orderpriority"), words).alias("priority"))


def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways to say an order's cents, and the readings and the word of its number."""
    o = _orders(spark, sf_dir)
    return o.select(
        "o_orderkey", F.array_join(spoken.spoken_forms(F.col("cents")), " ").alias("cents"), F.array_join(F.array_sort(spoken.chinese_forms(F.col("o_orderkey"))), " ").alias("readings"),
        F.coalesce(spoken.english_form(F.col("o_orderkey") % 101), F.lit("")).alias("word"),
    )


def spoken_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text says an order's cents, its number of days in words, and its date."""
    o = _orders(spark, sf_dir)
    ones = F.array(*[F.lit(w) for w in "zero one two three four five six seven eight nine ten".split()])
    n = (F.col("o_orderkey") % 11).cast("int")
    amount = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("$"), F.format_number(F.col("cents") / 100, 2))).otherwise(F.concat(F.lit("$"), F.format_number(F.col("cents") / 100 + 1, 2)))
    line = F.concat(F.lit("It costs "), amount, F.lit(" and takes "), F.element_at(ones, n + 1), F.lit(" days, due "), F.date_format("o_orderdate", "MMMM d"), F.lit("."))
    said = speech.stated(line)
    numbers = stated_numbers(line)
    return o.withColumn("numbers", numbers).withColumn("said", said).select(
        "o_orderkey", says(F.col("numbers"), F.col("cents")).alias("price"), says(F.col("numbers"), n).alias("days"), speech.says_date(F.col("said"), F.col("day")).alias("date"), speech.says_text(F.col("said"), F.lit("it  COSTS")).alias("words")
    )


def respellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of part sizes, order days and names that must grade the same, and whether they do."""
    p = T.table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.inline(F.array(F.struct(F.lit("integer").alias("kind"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("string").alias("kind"), F.col("p_name").alias("value")))))
    each = rows.select("p_partkey", "kind", "value", F.explode(grading.equivalents(F.col("value"), F.col("kind"))).alias("spelled"))
    return each.select("p_partkey", "kind", "spelled", (S.normal_text(F.col("value")) == S.normal_text(F.col("spelled"))).alias("same"))


def goal_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose goals differ in the later digits of their cents only."""
    o = _orders(spark, sf_dir)
    goals = F.array(F.struct(F.lit("pay").alias("process"), F.create_map(F.lit("cents"), F.col("cents").cast("string"), F.lit("kind"), "o_orderpriority").alias("params")), F.struct(F.lit("close").alias("process"), F.create_map(F.lit("by"), "o_orderstatus").alias("params")))
    out = o.select("o_orderkey", certify.goal_signature(goals).alias("signature"))
    return out.groupBy("signature").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


def results_by_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool results of events as an agent reads them in each style."""
    m = T.event_messages(spark, sf_dir).where("role = 'tool'")
    styled = m.select("msg_idx", "content", F.explode(F.array(F.lit("envelope"), F.lit("raw"), F.lit("text"))).alias("style"))
    return styled.select("msg_idx", "style", augment.rendered_result(F.col("content"), F.col("style")).alias("result"))


def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model replies with reasoning and calls, some of them broken."""
    m = T.event_messages(spark, sf_dir).where("role = 'assistant'")
    k = F.col("number")
    text = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit("<think>about "), k, F.when(k % 10 == 0, F.lit("")).otherwise(F.lit("</think>")))).otherwise(F.lit("")), F.when(k % 3 == 0, F.concat(F.lit(" say "), k)).otherwise(F.lit("")),
        F.when(k % 5 == 1, F.concat(F.lit('<tool_call>{"name": "f'), k, F.lit('"}'), F.when(k % 7 == 0, F.lit("")).otherwise(F.lit("</tool_call>")))).otherwise(F.lit("")),
    )
    r = certify.parsed_reply(text)
    return m.select("msg_idx", F.coalesce(r["reasoning"], F.lit("-")).alias("reasoning"), r["content"].alias("content"), F.size(r["calls"]).alias("calls"), F.coalesce(r["error"], F.lit("-")).alias("error"))


#: r: n and forms, the Chinese readings of the numbers n of v.
READINGS = r"""q AS (SELECT n, n // 10000 AS hi, n % 10000 AS lo, list_transform([n // 10000, n % 10000], lambda g: regexp_replace(regexp_replace(regexp_replace(
list_reduce(list_transform(['千', '百', '十', ''], lambda u, i: substr('零一二三四五六七八九', (g // [1000, 100, 10, 1][i] % 10 + 1)::INT, 1) || u), lambda a, b: a || b), '零[千百十]', '零', 'g'), '零+', '零', 'g'), '^零|零$', '', 'g')) AS g FROM v),
w AS (SELECT n, regexp_replace(CASE WHEN hi > 0 THEN g[1] || '万' || CASE WHEN lo > 0 AND lo < 1000 THEN '零' ELSE '' END ELSE '' END || g[2], '^一十', '十') AS w FROM q),
f AS (SELECT n, CASE WHEN n = 0 THEN ['零'] WHEN regexp_matches(w, '[一二三四五六七八九][百千万][一二三四五六七八九][十百千]$') THEN [w, left(w, length(w) - 1)] ELSE [w] END AS f FROM w),
r AS (SELECT n, list_concat(f, list_transform(list_filter(f, lambda x: starts_with(x, '二') AND (n < 10 OR NOT starts_with(x, '二十'))), lambda x: '两' || substr(x, 2))) AS forms FROM f),"""

QUERIES = {
    "names": (
        names,
        r"""SELECT p_partkey, regexp_replace(p_name || '-' || p_brand, '\W+', '_', 'g') AS safe, translate(p_brand, '0123456789', '3456789012') AS fabricated, p_size % 3 = 0 AS writes, regexp_replace(lower(p_name || ' #' || p_size), '[^0-9a-z]', '', 'g') AS loose,
p_partkey % 2 = 1 AS internal, p_size % 3 = 1 AS looks_up FROM part""",
    ),
    "calendar": (
        calendar,
        """SELECT o_orderkey, o_orderkey % 3 > 0 OR month(o_orderdate) IN (1, 3, 5, 7, 8, 10, 12) AS real, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M') AS later, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS before,
'Current time: ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') || ' (' || dayname(o_orderdate) || ')' AS clock FROM orders""",
    ),
    "peaks": (
        peaks,
        """WITH e AS (SELECT event_id, ts + INTERVAL 8 HOUR AS t FROM events), p AS (SELECT event_id, t, dayofweek(t) BETWEEN 1 AND 5 AND (hour(t) BETWEEN 9 AND 11 OR hour(t) BETWEEN 14 AND 17) AS peak FROM e),
b AS (SELECT event_id, t, peak, date_trunc('minute', t) AS m FROM p), d AS (SELECT *, CASE WHEN peak THEN date_trunc('day', t) + INTERVAL 1 HOUR * CASE WHEN hour(t) < 12 THEN 12 ELSE 18 END
WHEN dayofweek(t) BETWEEN 1 AND 5 AND hour(t) < 9 THEN date_trunc('day', t) + INTERVAL 9 HOUR WHEN dayofweek(t) BETWEEN 1 AND 5 AND hour(t) < 14 THEN date_trunc('day', t) + INTERVAL 14 HOUR
WHEN dayofweek(t) = 6 THEN date_trunc('day', t) + INTERVAL 57 HOUR WHEN dayofweek(t) = 5 THEN date_trunc('day', t) + INTERVAL 81 HOUR ELSE date_trunc('day', t) + INTERVAL 33 HOUR END AS n FROM b)
SELECT event_id, peak, (epoch(n) - epoch(m))::BIGINT AS seconds FROM d""",
    ),
    "quotes": (
        quotes,
        r"""WITH f AS (SELECT conv_id, text AS request FROM conversations WHERE turn = 0), q AS (SELECT c.conv_id, c.turn, trim(regexp_replace(substr(c.text, 1, 12), '\s+', ' ', 'g')) AS q, trim(regexp_replace(request, '\s+', ' ', 'g')) AS r FROM conversations c LEFT JOIN f USING (conv_id))
SELECT conv_id, turn, coalesce(length(q) >= 4 AND contains(r, q), false) AS quoted FROM q""",
    ),
    "shares": (
        shares,
        """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 + o_orderkey % 7 = 8 THEN round((o_orderkey % 5 + 1) / 10.0, 6) END AS easy,
CASE WHEN o_orderkey % 4 = 0 THEN 'direct' WHEN o_orderkey % 3 = 2 THEN 'complex' WHEN o_orderkey % 3 = 1 THEN 'single_write' WHEN o_orderkey % 2 = 0 THEN 'ordinary' ELSE 'simple' END AS shape FROM orders)
SELECT *, CASE o_orderkey % 5 WHEN 0 THEN shape = 'direct' WHEN 1 THEN shape = 'simple' ELSE shape IN ('ordinary', 'single_write', 'complex') END AS fits FROM s""",
    ),
    "number_words": (
        number_words,
        f"""WITH n AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders), v AS (SELECT o_orderkey AS n FROM n UNION SELECT c FROM n UNION SELECT c // 100 FROM n),
{READINGS}
s AS (SELECT o_orderkey, c, list_sort(list_distinct(list_concat(a.forms, [format('{{:,}}', c), printf('%.2f', c / 100.0::DOUBLE), format('{{:,.2f}}', c / 100.0::DOUBLE)], [x for x in [CASE WHEN c < 1000000 THEN printf('%g', c::DOUBLE) END, CASE WHEN c < 100000000 THEN printf('%g', round_even(c / 100.0::DOUBLE, 6 - CASE WHEN c < 100 THEN 0 ELSE length((c // 100)::VARCHAR) END::INT)) END] if x IS NOT NULL],
CASE WHEN c % 100 = 0 THEN b.forms WHEN c % 10 = 0 THEN list_append(list_transform(b.forms, lambda w: w || '块' || substr('零一二三四五六七八九', c // 10 % 10 + 1, 1)), (c // 100) || '块' || (c // 10 % 10)) ELSE [] END))) AS forms
FROM n JOIN r a ON a.n = c JOIN r b ON b.n = c // 100)
SELECT o_orderkey, array_to_string(s.forms, ' ') AS cents, array_to_string(list_sort(r.forms), ' ') AS readings, coalesce(CASE WHEN o_orderkey % 101 <= 20 THEN string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty', ' ')[o_orderkey % 101 + 1]
WHEN o_orderkey % 101 < 100 AND o_orderkey % 101 % 10 = 0 THEN string_split('thirty forty fifty sixty seventy eighty ninety', ' ')[o_orderkey % 101 // 10 - 2] END, '') AS word FROM s JOIN r ON r.n = o_orderkey""",
    ),
    "loose_answers": (
        loose_answers,
        "SELECT o_orderkey, o_orderkey % 2 = 0 AS price, o_orderkey % 3 = 0 OR lower(o_orderpriority) = 'low' AS priority FROM orders",
    ),
    "spoken_prices": (
        spoken_prices,
        """WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS c, day(o_orderdate) AS d FROM orders), n AS (SELECT o_orderkey, c, c + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 100 END AS said, d, o_orderkey % 11 AS w FROM o)
SELECT o_orderkey, said = c OR c IN (w, d, w * 100, d * 100) OR said = c * 100 AS price, true AS days, true AS date, true AS words FROM n""",
    ),
    "respellings": (
        respellings,
        """SELECT p_partkey, 'integer' AS kind, p_size || '.00' AS spelled, true AS same FROM part UNION ALL SELECT p_partkey, 'integer', '$' || p_size || '.00', true FROM part
UNION ALL SELECT p_partkey, 'string', upper(p_name), true FROM part UNION ALL SELECT p_partkey, 'string', ' ' || p_name || ' ', true FROM part""",
    ),
    "goal_signatures": (
        goal_signatures,
        """WITH o AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, round(o_totalprice * 100)::BIGINT AS c FROM orders), b AS (SELECT *, pow(10, length(c::VARCHAR) - 1)::BIGINT AS z FROM o),
g AS (SELECT o_orderkey, 'close|{"by":"' || s || '"};pay|{"cents":"' || CASE WHEN c = 0 THEN 0 ELSE (round_even(c / z, 0) * z)::BIGINT END || '","kind":"' || p || '"}' AS signature FROM b) SELECT signature, count(*) AS n, min(o_orderkey) AS first FROM g GROUP BY 1""",
    ),
    "results_by_style": (
        results_by_style,
        """WITH m AS (SELECT event_id AS msg_idx, event_type = 'purchase' AS ok, (props->>'$.k')::INT AS k FROM events WHERE event_type IN ('error', 'purchase')),
r AS (SELECT *, CASE WHEN ok THEN '{"ok": true, "result": "' || k || '"}' WHEN k % 2 = 0 THEN 'Error: ' || k ELSE '{"ok": false, "error": "' || k || '"}' END AS c FROM m)
SELECT msg_idx, 'envelope' AS style, c AS result FROM r UNION ALL SELECT msg_idx, 'raw', CASE WHEN ok THEN k::VARCHAR ELSE 'Error: ' || k END FROM r UNION ALL SELECT msg_idx, 'text', CASE WHEN NOT ok AND k % 2 = 0 THEN c ELSE k::VARCHAR END FROM r""",
    ),
    "parsed_replies": (
        parsed_replies,
        """WITH m AS (SELECT event_id AS msg_idx, (props->>'$.k')::INT AS k FROM events WHERE event_type IN ('view', 'click')), p AS (SELECT *, k % 10 = 0 AS cut, k % 5 = 1 AS called, k % 5 = 1 AND k % 7 = 0 AS torn FROM m),
t AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'say ' || k ELSE '' END AS words FROM p)
SELECT msg_idx, CASE WHEN k % 2 = 1 THEN '-' WHEN cut THEN 'about ' || k || CASE WHEN k % 3 = 0 THEN ' say ' || k ELSE '' END ELSE 'about ' || k END AS reasoning,
CASE WHEN cut THEN trim(substr('about ' || k || CASE WHEN k % 3 = 0 THEN ' say ' || k ELSE '' END, 8)) ELSE words END AS content, called::INT AS calls,
CASE WHEN cut THEN 'incomplete reasoning block' WHEN torn THEN 'incomplete tool call' WHEN NOT called AND words = '' THEN 'empty assistant response' ELSE '-' END AS error FROM t""",
    ),
}
