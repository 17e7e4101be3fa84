"""SQL for DuckDB that gives the rows of those queries which SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALNUM}') AS w FROM benchmark),
s AS (SELECT item_id, w, CAST(least(13, len(w)) AS BIGINT) AS m FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda p: array_to_string(w[p:p + m - 1], ' '))) AS k FROM s),
sizes AS (SELECT DISTINCT m FROM win),
x AS (SELECT doc_id, w, m, greatest(len(w) - m + 2, 1) AS top FROM d, sizes),
dwin AS (SELECT doc_id, m, unnest(list_transform(range(1, top), lambda p: array_to_string(w[p:p + m - 1], ' '))) AS k, unnest(range(1, top)) AS p FROM x),
hit AS (SELECT doc_id, p, dwin.m, item_id FROM dwin JOIN win ON win.m = dwin.m AND win.k = dwin.k),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
 sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

# No page of these tables links to another host, so no host has received trust or distrust.
URL_FILTERS = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rule, h, q) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, w, greatest(len(w) - 18, 1) AS top FROM d),
win AS (SELECT doc_id, unnest(list_transform(range(1, top), lambda p: array_to_string(w[p:p + 19], ' '))) AS k, unnest(range(1, top)) AS p FROM x),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM r WHERE rn > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.q) AS t, count(*) AS c FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.q = word.q WHERE gone.q IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, greatest(len(w) - 6, 1) AS top FROM w),
win AS (SELECT doc_id, unnest(list_transform(range(1, top), lambda p: array_to_string(w[p:p + 7], ' '))) AS k, unnest(range(1, top)) AS p FROM c),
twice AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice WHERE n > 1) GROUP BY doc_id),
j AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(word_chars, 1) AS bare, CAST(len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS stutter FROM c LEFT JOIN rep ON rep.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * n_dup_lines > length(t) - length(replace(t, chr(10), '')) + 1
 OR 2 * length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) > bare OR 10 * length(regexp_replace(t, '[^!?]', '', 'g')) > 3 * n_words OR 10 * stutter > 3 * n_words
 OR 2 * length(regexp_replace(t, '\P{{L}}', '', 'g')) < bare) AS kept FROM b"""

SQL = {
    "op1_decontamination": DECONTAMINATION,
    "op6_url_filters": URL_FILTERS,
    "op9_substring_dedup": SUBSTRING_DEDUP,
    "op10_quality_rules": QUALITY_RULES,
}
