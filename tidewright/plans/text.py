"""Queries on near-duplicates, contamination, phrases and flags in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.operators import text as X
from tidewright.sources import tables as T


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents with the class of those with the same grams, and the pairs of classes of similarity 0.9 or more.

    Whole texts of one language share most of their 3-grams: unrelated ones are up to 0.6 alike.
    """
    texts = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), S.without_space(F.lower("text")).alias("text"))
    members, pairs = X.similar_texts(texts, 0.9)
    return members.withColumnRenamed("id", "doc_id"), pairs


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents, by their whole texts: the class of those with the same character 3-grams, and how many others are 0.9 alike."""
    members, pairs = _near(spark, sf_dir)
    return X.links_by_class(members, "doc_id", pairs)


def greedy_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay when each, by number, is dropped if its whole text is like one already kept."""
    members, pairs = _near(spark, sf_dir)
    return X.greedy_keep(members.where("doc_id = class").select("doc_id"), "doc_id", pairs)


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a word 8-gram with a benchmark item."""
    return X.contaminated(T.table(spark, sf_dir, "documents"), "doc_id", "text", T.table(spark, sf_dir, "benchmark"), "text")


def stock_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two words in three texts in a hundred or more of the English documents."""
    docs = T.table(spark, sf_dir, "documents").where("lang = 'en'")
    return X.stock_phrases(docs, "text", n=2, share=0.03)


def opening_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock starts and distinct prefixes of the first user turns."""
    first = T.messages(spark, sf_dir).where("role = 'user'").groupBy("episode_id").agg(F.min_by("content", "msg_idx").alias("t"))
    out = X.opening_diversity(first, "t", r"^(The|In|On|An|To) ")
    return out.select("texts", F.round("stock_share", 6).alias("stock_share"), "prefixes")


def red_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged wording in documents."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(S.red_flags(F.col("text"))).alias("flag"))
    return docs


def signature_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each opening of 160 characters."""
    return X.signature_dedup(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant replies in the shape of reports, or leaking internals, by conversation."""
    m = T.messages(spark, sf_dir).where("role = 'assistant'")
    return m.groupBy("episode_id").agg(F.sum(S.is_report(F.col("content"), 400).cast("int")).alias("reports"), F.sum(S.leaks_internals(F.col("content")).cast("int")).alias("leaks"))


GRAMS = r"""grams AS (SELECT doc_id, CASE WHEN length(t) >= 3 THEN list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) ELSE [t] END AS g
FROM (SELECT doc_id, t, string_split(t, '') AS c FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '\s+', '', 'g') AS t FROM documents))),
members AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(g)) AS class FROM grams),
each AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM grams WHERE doc_id IN (SELECT class FROM members)),
pairs AS (SELECT a.doc_id AS "left", b.doc_id AS "right", count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity FROM each a JOIN each b ON a.gram = b.gram AND a.doc_id < b.doc_id
AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n) - 1e-9 GROUP BY 1, 2 HAVING similarity >= 0.9)"""

QUERIES = {
    "near_duplicates": (
        near_duplicates,
        f"""WITH {GRAMS}, ends AS (SELECT "left" AS class, "right" AS other FROM pairs UNION ALL SELECT "right", "left" FROM pairs), sizes AS (SELECT class AS other, count(*) AS n FROM members GROUP BY 1),
links AS (SELECT class, sum(n)::BIGINT AS links FROM ends JOIN sizes USING (other) GROUP BY 1) SELECT doc_id, class, coalesce(links, 0) AS links FROM members LEFT JOIN links USING (class)""",
    ),
    "greedy_keep": (
        greedy_keep,
        f"""WITH RECURSIVE {GRAMS}, near AS (SELECT "right" AS id, list("left") AS l FROM pairs GROUP BY 1),
o AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS k, coalesce(l, []) AS l FROM members LEFT JOIN near ON near.id = doc_id WHERE doc_id = class),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept UNION ALL SELECT o.k, CASE WHEN list_has_any(kept, o.l) THEN kept ELSE list_append(kept, o.id) END FROM walk JOIN o ON o.k = walk.k + 1)
SELECT unnest(kept) AS doc_id FROM walk WHERE k = (SELECT max(k) FROM o)""",
    ),
    "contamination": (
        contamination,
        r"""WITH b AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') AS w FROM documents),
banned AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM b WHERE len(w) >= 8),
grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram FROM d WHERE len(w) >= 8)
SELECT DISTINCT doc_id FROM grams SEMI JOIN banned USING (gram)""",
    ),
    "stock_phrases": (
        stock_phrases,
        r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM documents WHERE lang = 'en'),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM d WHERE len(w) >= 2)
SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= greatest(3, floor(0.03 * (SELECT count(*) FROM d))::BIGINT + 1) AND NOT regexp_matches(gram, '[0-9]')""",
    ),
    "opening_diversity": (
        opening_diversity,
        r"""WITH f AS (SELECT conv_id, min_by(coalesce(text, ''), turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT count(*) AS texts, round(avg(regexp_matches(t, '^(The|In|On|An|To) ')::INT), 6) AS stock_share, count(DISTINCT substr(t, 1, 2)) AS prefixes FROM f""",
    ),
    "red_flags": (
        red_flags,
        r"""WITH r(flag, p) AS (VALUES ('amount in cents (users say dollars)', '(?i)\b[0-9]+\s*cents?\b'),
('dictates the confirmation protocol', '(?i)\b(confirm|check) with me (first|before)|\bwait for my (ok|approval|confirmation)|\bbefore (each|every) (step|item|one)\b'),
('virtual clock', '(?i)\b(current )?time (is )?[0-9]+\b|\bday [0-9]+\b|\bvirtual\b|time\.start'), ('transaction semantics', '(?i)\batomic|\broll ?back\b'))
SELECT doc_id, flag FROM documents, r WHERE regexp_matches(text, p)""",
    ),
    "signature_dedup": (
        signature_dedup,
        r"""SELECT min(doc_id) AS doc_id FROM documents GROUP BY substr(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\x0b\f]+', ' ', 'g')), 1, 160)""",
    ),
    "reports": (
        reports,
        r"""SELECT conv_id AS episode_id, sum((length(t) > 400 OR regexp_matches(t, '(?im)(here''?s (the|a|your) (outcome|summary|picture|result|breakdown|overview)|^\s*#{1,4} |\n\s*\*\*[^*\n]{2,40}\*\*\s*\n\s*[-•])'))::INT)::BIGINT AS reports,
sum(regexp_matches(t, '[A-Za-z]+_[A-Za-z_]+|\b[0-9]+\s*cents?\b')::INT)::BIGINT AS leaks FROM (SELECT conv_id, coalesce(text, '') AS t FROM conversations WHERE role = 'assistant') GROUP BY conv_id""",
    ),
}
