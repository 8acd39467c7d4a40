"""DuckDB oracles of the operators that SQL can express, written from the contracts."""

from __future__ import annotations

# A-Z lower-cased only: lower() would change other letters too
_ASCII_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, word: str) -> str:
    return f"regexp_extract_all({_ASCII_LOWER.format(t=text)}, '{word}')"


_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP9 = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_words("coalesce(text, '')", _BENCH_WORD)} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM item, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, {_words("coalesce(text, '')", _BENCH_WORD)} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
  FROM doc, sizes, unnest(generate_series(1, len(w) - n + 1)) AS g(i) WHERE len(w) >= n),
hit AS (SELECT pos.doc_id, pos.n, pos.i, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.win = win.win),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS g(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
         length(coalesce(text, '')) AS size FROM documents),
r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""

OP13 = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_ASCII_LOWER.format(t="coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
occurring AS (
  SELECT lang, m, list_slice(w, i, i + m - 1) AS ws
  FROM words, unnest([1, 2, 3, 4]) AS s(m), unnest(generate_series(1, len(w) - m + 1)) AS g(i) WHERE len(w) >= m),
f AS (SELECT lang, m, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM occurring GROUP BY lang, m, ws HAVING count(*) >= 30),
parts AS (
  SELECT lang, m, phrase, f AS a, k, array_to_string(list_slice(ws, 1, k), ' ') AS first, array_to_string(list_slice(ws, k + 1, m), ' ') AS rest
  FROM f, unnest([1, 2, 3]) AS s(k) WHERE k < m),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, 2000000::HUGEINT * c.a // (l.f + r.f) AS score
  FROM parts c JOIN f l ON l.lang = c.lang AND l.phrase = c.first JOIN f r ON r.lang = c.lang AND r.phrase = c.rest),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS phrase, f
  FROM f, unnest([2, 3]) AS s(n), unnest([1, 2, 3]) AS g(i) WHERE n < m AND i + n - 1 <= m),
longer AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY lang, phrase),
kept AS (
  SELECT b.lang, b.phrase, a, l, r, score
  FROM best b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase WHERE longer.f IS NULL OR 100 * longer.f < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

ORACLE = {"op7_exact_dedup": OP7, "op9_decontaminate": OP9, "op13_collocations": OP13}
