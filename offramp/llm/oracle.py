"""The same rows in SQL, for the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP10 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
           + CASE WHEN n_words > 1000000 THEN 4 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
           + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END
           + CASE WHEN 10 * n_symbols > 3 * n_words THEN 32 ELSE 0 END
           + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & 127) = 0 AS kept, failed FROM f
"""

OP8 = rf"""
WITH s AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS digest FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM t)),
k AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(2 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT min_by(level, ratio) AS level FROM k WHERE 2 * source_size >= level * weight),
g AS (SELECT source, source_size, least(weight * level, (2 * source_size)::DOUBLE) AS target,
             ('0x' || substr(md5('8:' || coalesce('source ' || source, 'none')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM w CROSS JOIN l),
r AS (
  SELECT doc_id, size, source_size, target, u, least(target / nullif(source_size, 0)::DOUBLE, 2.0::DOUBLE) AS step,
         (row_number() OVER (PARTITION BY s.source ORDER BY size, digest, doc_id))::DOUBLE AS rank
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       coalesce((floor(u + rank * step) - floor(u + (rank - 1) * step)) * size, 0)::BIGINT AS taken FROM r
"""

OP2 = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS line_no, trim(unnest(lines), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS turn FROM l WHERE length(line) >= 16),
u AS (SELECT line, length(line) AS n, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM o WHERE turn = 1),
k AS (SELECT *, n AS m FROM u UNION ALL SELECT *, n - 1 FROM u),
c AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.n, b.n AS bn, a.place AS ap, b.place AS bp
  FROM u a JOIN k b ON a.n = b.m AND a.line <> b.line AND left(a.line, a.n // 2) = left(b.line, b.m // 2)
  UNION
  SELECT DISTINCT a.line, b.line, a.n, b.n, a.place, b.place
  FROM u a JOIN k b ON a.n = b.m AND a.line <> b.line AND right(a.line, a.n - a.n // 2) = right(b.line, b.m - b.m // 2)),
p AS (
  SELECT * FROM c WHERE len(list_filter(range(0, n + 1), lambda i: left(a, i) = left(b, i)
    AND substr(a, i + 2 - (bn - n)) = substr(b, i + 2))) > 0),
near AS (SELECT CASE WHEN ap > bp THEN a ELSE b END AS line FROM p GROUP BY 1),
x AS (SELECT o.doc_id, o.line_no, o.turn > 1 AS exact FROM o LEFT JOIN near ON near.line = o.line
      WHERE o.turn > 1 OR near.line IS NOT NULL),
g AS (SELECT doc_id, list(line_no) AS gone, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_near FROM x GROUP BY doc_id)
SELECT d.doc_id,
       array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT coalesce(list_contains(gone, i), false)], chr(10)) AS text,
       len(lines)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""

OP12 = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS alike, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id)::INTEGER AS rank,
       s.row_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

ORACLE = {
    "op2_line_dedup": OP2,
    "op8_mixing": OP8,
    "op10_quality_rules": OP10,
    "op12_hard_negatives": OP12,
}
