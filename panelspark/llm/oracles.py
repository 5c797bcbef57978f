"""SQL of the queries whose method leaves a result that SQL can state."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"
_SPACED = r"'[^\x20\x09-\x0D]'"

#: Figures and the conjunction of all rules of ``quality.RULES``; the order of the cascade does not matter.
QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, doc_id, text, regexp_extract_all(text, {_WORD}) AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM s),
per_word AS (
  SELECT rid, sum(length(word)) AS word_chars, count(CASE WHEN NOT regexp_matches(word, '[A-Za-z]|[^\x00-\x7F]') THEN 1 END) AS n_wordless,
    count(CASE WHEN word = before THEN 1 END) AS n_echoes
  FROM (SELECT *, lag(word) OVER (PARTITION BY rid ORDER BY i) AS before FROM w) GROUP BY 1),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM s WHERE len(ws) >= 8)),
again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY 1),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup, count(CASE WHEN regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$') THEN 1 END) AS n_trailing
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_SPACED}) GROUP BY 1),
f AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_trailing, 0) AS n_trailing, coalesce(n_wordless, 0) AS n_wordless,
    coalesce(n_echoes, 0) AS n_echoes, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_shouted, length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
  FROM s LEFT JOIN per_word USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 2 * n_dup_lines > n_lines OR 2 * n_shouted > n_letters
    OR 10 * n_echoes > 2 * n_words OR 10 * n_wordless > 3 * n_words OR 10 * n_trailing > 3 * n_lines) AS kept
FROM b"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLDED}, {_TERM}) AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_FOLDED}, {_TERM}) AS ws FROM benchmark),
phrases AS (
  SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM phrases),
grams AS (SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT rid, i, n, item FROM grams JOIN phrases USING (n, g)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)"""
