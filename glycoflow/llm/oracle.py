"""DuckDB SQL for the numbered queries whose results follow from their contract alone."""

from __future__ import annotations

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM texts),
spans AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER ahead AS span, count(*) OVER ahead AS n
  FROM words WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT doc_id, i FROM spans WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1),
marked AS (
  SELECT w.doc_id, w.i, w.word, count(l.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.i = w.i),
counted AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_gone, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_words, coalesce(c.n_gone, 0) AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN counted c ON c.doc_id = d.doc_id
"""

OP8 = rf"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM texts),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_FOLD}) AS k FROM lines),
common AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.holder AS gone FROM keyed l LEFT JOIN common c ON c.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(10, len(ws)) AS width, array_to_string(ws[j : j + least(10, len(ws)) - 1], ' ') AS span
  FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS j FROM items WHERE len(ws) > 0)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM texts),
ahead AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS next FROM words),
spans AS (
  SELECT a.doc_id, a.i, w.width, array_to_string(a.next[1 : w.width], ' ') AS span
  FROM ahead a JOIN (SELECT DISTINCT width FROM item_windows) w ON len(a.next) >= w.width),
hits AS (SELECT s.doc_id, s.i, s.width, b.item FROM spans s JOIN item_windows b ON b.width = s.width AND b.span = s.span),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT t.doc_id, len(t.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
  sha256(coalesce(m.listed, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit_words h ON h.doc_id = t.doc_id LEFT JOIN hit_items m ON m.doc_id = t.doc_id
"""

OP5 = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM texts),
windows AS (
  SELECT doc_id, i, md5(string_agg(word, ' ') OVER five) AS w5, count(*) OVER five AS n5, md5(string_agg(word, ' ') OVER long) AS w101, count(*) OVER long AS n101
  FROM words WINDOW five AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), long AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 100 FOLLOWING)),
twice AS (SELECT doc_id, i FROM windows WHERE n5 = 5 QUALIFY count(*) OVER (PARTITION BY doc_id, w5) > 1),
covered AS (
  SELECT w.doc_id, count(t.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0 AS hit
  FROM words w LEFT JOIN twice t ON t.doc_id = w.doc_id AND t.i = w.i),
repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM covered GROUP BY doc_id),
longer AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM windows WHERE n101 = 101 GROUP BY doc_id, w101 HAVING count(*) > 1)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT t.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, l.doc_id IS NOT NULL AS long_repeat
  FROM texts t LEFT JOIN dup d ON d.doc_id = t.doc_id LEFT JOIN repeats r ON r.doc_id = t.doc_id LEFT JOIN longer l ON l.doc_id = t.doc_id)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT long_repeat AS kept
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
"""

#: All pairs that share a shingle, with exact document frequencies and the floor under them; classes by following links to the end.
OP9 = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM texts WHERE len(ws) >= 5),
windows AS (SELECT doc_id, md5(string_agg(word, ' ') OVER five) AS s, count(*) OVER five AS n FROM words WINDOW five AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
shingles AS (SELECT doc_id, s FROM windows WHERE n = 5 UNION ALL SELECT doc_id, md5(array_to_string(ws, ' ')) FROM texts WHERE len(ws) BETWEEN 1 AND 4),
bags AS (SELECT doc_id, s, count(*) AS k FROM shingles GROUP BY doc_id, s),
frequency AS (SELECT s, count(*) AS df FROM bags GROUP BY s),
total AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM bags) AS t),
weighted AS MATERIALIZED (
  SELECT doc_id, s, (1 + ln(k)) * (1 + ln((1 + n) / (1.0::DOUBLE + greatest(df, 1, n / 1000.0::DOUBLE, t / 2097152.0::DOUBLE))) / ln(1000)) AS w
  FROM bags JOIN frequency USING (s), total),
mass AS MATERIALIZED (SELECT doc_id, sum(w) AS m FROM weighted GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.w, b.w)) AS both_ FROM weighted a JOIN weighted b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b, both_ / (x.m + y.m - both_) AS similarity FROM pairs JOIN mass x ON x.doc_id = a JOIN mass y ON y.doc_id = b WHERE both_ >= 0.8 * (x.m + y.m - both_) * (1 - 1e-12)),
edges AS MATERIALIZED (SELECT a, b, similarity FROM links UNION ALL SELECT b, a, similarity FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
same AS MATERIALIZED (SELECT d.doc_id, least(d.doc_id, min(e.b)) AS rep FROM documents d LEFT JOIN edges e ON e.a = d.doc_id AND e.similarity > 1 - 1e-9 GROUP BY d.doc_id),
degree AS (SELECT s.rep, count(DISTINCT t.rep) AS n FROM edges e JOIN same s ON s.doc_id = e.a JOIN same t ON t.doc_id = e.b WHERE s.rep <> t.rep GROUP BY s.rep)
SELECT r.a AS doc_id, min(r.b) AS class_id, CAST(coalesce(any_value(d.n), 0) AS BIGINT) AS n_links
FROM reach r JOIN same s ON s.doc_id = r.a LEFT JOIN degree d ON d.rep = s.rep GROUP BY r.a
"""



def _op13(rounds: int = 6) -> str:
    """Integer parts and distances are whole doubles far below 2**53, so all of it is exact."""
    steps = [
        r"""
WITH kept AS (
  SELECT vec_id, label, [floor(CAST(e AS DOUBLE) * 4096) FOR e IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1 : (p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS r(p)),
books0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS e FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16)"""
    ]
    for i in range(rounds + 1):
        steps.append(rf"""
near{i} AS MATERIALIZED (
  SELECT t.vec_id, t.p, t.x, min(struct_pack(d := list_dot_product(t.x, t.x) - 2 * list_dot_product(t.x, b.e) + list_dot_product(b.e, b.e), k := b.k)) AS m
  FROM parts t JOIN books{i} b ON b.p = t.p GROUP BY t.vec_id, t.p, t.x)""")
        if i < rounds:
            steps.append(rf"""
means{i} AS (
  SELECT p, k, list(e ORDER BY j) AS e FROM (
    SELECT p, k, j, floor(sum(y) / count(*)) AS e
    FROM (SELECT p, m.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM near{i}) GROUP BY p, k, j)
  GROUP BY p, k),
books{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(n.e, b.e) AS e FROM books{i} b LEFT JOIN means{i} n ON n.p = b.p AND n.k = b.k)""")
    steps.append(rf"""
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', m.k), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
printed AS (
  SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256
  FROM (SELECT p, k, unnest(e) AS y, generate_subscripts(e, 1) AS j FROM books{rounds}))
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, b.codebooks_sha256
FROM coded c JOIN kept v ON v.vec_id = c.vec_id, printed b
""")
    return ",".join(steps[:-1]) + "," + steps[-1]


OP13 = _op13()

#: The others depend on a trained model, packing, a vocabulary or eigenvectors.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1, "op5_quality_rules": OP5, "op8_line_dedup": OP8, "op9_minhash": OP9, "op10_decontamination": OP10, "op13_vector_codes": OP13,
}
