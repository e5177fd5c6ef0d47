"""DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .licenses import NOTICES

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS same,
    length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]|NEXT\]))', '\1\\\2', 'g')) AS role_chars,
    length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]|NEXT\]))', '\1\\\2', 'g')) AS text_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN same THEN 6 ELSE role_chars + 20 END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

URLS = r"""
WITH captures AS (
  SELECT page_id, url, (TIMESTAMP '2024-01-01' + ((page_id * 7919) % 525600) * INTERVAL 1 MINUTE) AS fetched,
    lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)', 2)) AS host,
    regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*):([0-9]+)', 3) AS port,
    string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') AS steps
  FROM pages
), places AS (
  SELECT page_id, url, fetched, unnest(list_transform(range(1, len(steps) + 1), lambda i: array_to_string(steps[1:i], '/'))) AS prefix, port,
    CASE WHEN regexp_matches(host, '^(\[|[0-9.]+$)') THEN [host] ELSE list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END AS domains
  FROM captures WHERE host <> ''
), asked AS (
  SELECT DISTINCT page_id, url, fetched, d || CASE WHEN with_port THEN ':' || port ELSE '' END || prefix AS pattern
  FROM (SELECT *, unnest(domains) AS d FROM places), (VALUES (false), (true)) v(with_port) WHERE NOT with_port OR port <> ''
), codes AS (
  SELECT host AS pattern, ('0x' || substr(md5(host), 1, 7))::BIGINT AS code FROM (SELECT DISTINCT host FROM captures WHERE host <> '')
), entries AS (
  SELECT pattern, TIMESTAMP '2024-01-01' + (code % 200) * INTERVAL 1 DAY AS made, true AS listed FROM codes WHERE code % 4 = 0
  UNION ALL SELECT pattern, TIMESTAMP '2024-01-01' + (code % 200 + 60) * INTERVAL 1 DAY, false FROM codes WHERE code % 4 = 0
  UNION ALL SELECT pattern, TIMESTAMP '2024-01-01' + (code % 200 + 60 + code % 90) * INTERVAL 1 DAY, true FROM codes WHERE code % 4 = 0
  UNION ALL SELECT 'example.org', TIMESTAMP '2024-05-01', true
  UNION ALL SELECT 'example.org', TIMESTAMP '2024-06-01', false
  UNION ALL SELECT 'example.net/de', TIMESTAMP '2024-02-29' + INTERVAL 1 DAY, true
), dated AS (
  SELECT pattern, made, bool_or(listed) AS listed FROM entries GROUP BY pattern, made
), spans AS (
  SELECT * FROM (SELECT pattern, made AS since, lead(made) OVER (PARTITION BY pattern ORDER BY made) AS until, listed FROM dated) WHERE listed
), matched AS (
  SELECT c.page_id, c.url, s.pattern, s.since, row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(s.pattern) DESC, s.pattern, s.since) AS k
  FROM asked c JOIN spans s ON s.pattern = c.pattern AND s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until)
)
SELECT c.page_id, c.fetched, m.page_id IS NOT NULL AS blocked, m.pattern, m.since
FROM captures c LEFT JOIN matched m ON m.k = 1 AND m.page_id = c.page_id AND m.url = c.url
"""


def licenses_sql(threshold: float = 0.85) -> str:
    """The licence scan: each template against every run of as many words, by joins over word places."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    known = ", ".join(f"({k}, {quote(name)}, {quote(text)})" for k, (name, text) in enumerate((n, t) for n, texts in NOTICES.items() for t in texts))
    words = lambda text: f"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9.]+', ' ', 'g'), ' '), lambda x: trim(x, '.')), lambda x: x <> '')"
    ratio = threshold / (2 - threshold)
    return rf"""
WITH known(k, license, text) AS (VALUES {known}), tw AS (SELECT k, license, {words("text")} AS w FROM known),
tg AS (SELECT DISTINCT k, g FROM (SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw)),
t AS (SELECT k, license, len(w) AS l, (SELECT count(*) FROM tg WHERE tg.k = tw.k) AS m FROM tw),
dw AS (SELECT row_number() OVER () AS d, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
places AS (SELECT d, doc_id, len(w) AS n, generate_subscripts(w, 1) - 1 AS p, w, unnest(w) AS word FROM dw),
grams AS (SELECT d, doc_id, n, p, word || ' ' || w[p + 2] AS g FROM places WHERE p < n - 1),
hits AS (SELECT d, k, p, g FROM grams JOIN tg USING (g)),
likely AS (SELECT d, k FROM hits JOIN t USING (k) GROUP BY d, k, m HAVING count(DISTINCT g) >= ceil(m * {ratio!r} - 1e-9)),
fresh AS (SELECT d, doc_id, n, p, g, coalesce(lag(p) OVER (PARTITION BY d, g ORDER BY p), -1) AS before FROM grams SEMI JOIN likely USING (d)),
cases AS (SELECT d, k, license, m, least(l, n) AS l, n - least(l, n) AS last FROM likely JOIN t USING (k) JOIN (SELECT DISTINCT d, n FROM fresh) USING (d)),
held AS (SELECT c.d, c.k, c.license, c.m, c.l, s.s, count(*) AS size, count(tg.g) AS shared FROM cases c, range(c.last + 1) s(s)
  JOIN fresh f ON f.d = c.d AND f.p >= s.s AND f.p <= s.s + c.l - 2 AND f.before < s.s LEFT JOIN tg ON tg.k = c.k AND tg.g = f.g GROUP BY ALL),
good AS (SELECT *, 2 * shared / (size + m) AS dice FROM held WHERE 2 * shared / (size + m) >= {threshold!r}),
marked AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY d, k ORDER BY s) < l THEN 0 ELSE 1 END AS first FROM good),
islands AS (SELECT *, sum(first) OVER (PARTITION BY d, k ORDER BY s) AS island FROM marked),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d, k, island ORDER BY dice DESC, s) AS place FROM islands) WHERE place = 1)
SELECT (SELECT doc_id FROM dw WHERE dw.d = x.d) AS doc_id, license, s::INT AS start, l::INT AS words, round(dice, 6) AS dice FROM best x
WHERE NOT EXISTS (SELECT 1 FROM best y WHERE y.d = x.d AND y.s < x.s + x.l AND x.s < y.s + y.l AND (y.m > x.m OR (y.m = x.m AND (y.dice > x.dice OR (y.dice = x.dice AND y.k < x.k)))))
"""


ORACLES: dict[str, str] = {"op1_licenses": licenses_sql(), "op7_chat": CHAT, "op8_url_filter": URLS}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
