"""DuckDB texts of the queries that SQL can express."""

ORACLES = {
    "op1_mixing": r"""
WITH sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
per AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS bound,
  CAST(CASE (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM per),
total AS (SELECT 1.5::DOUBLE * SUM(source_size) AS words FROM weighed),
levels AS (SELECT a.bound / a.weight AS ratio,
  ((SELECT words FROM total) - SUM(CASE WHEN b.bound / b.weight < a.bound / a.weight THEN b.bound ELSE 0 END))
  / SUM(CASE WHEN b.bound / b.weight < a.bound / a.weight THEN 0 ELSE b.weight END) AS level
  FROM weighed a, weighed b GROUP BY a.source, a.bound, a.weight),
chosen AS (SELECT MIN(level) AS level FROM levels WHERE ratio = (SELECT MIN(ratio) FROM levels WHERE level <= ratio)),
targets AS (SELECT source, source_size, LEAST(bound, weight * level) AS target FROM weighed, chosen),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate,
  CAST(('0x' || substr(md5('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS chance
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (FLOOR(rate) + CASE WHEN chance < rate - FLOOR(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
""",
    "op4_url_filters": r"""
WITH rules(verdict, rule, h, p) AS (VALUES ('block','com/en/','com','/en/'),('allow','example.com/en/7','example.com','/en/7'),
  ('allow','net/de/','net','/de/'),('block','example.net/de/8','example.net','/de/8'),('block','org/es/','org','/es/')),
parts AS (SELECT page_id, ROW_NUMBER() OVER () AS rid,
  translate(COALESCE(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  COALESCE(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT rid, rule, verdict, ROW_NUMBER() OVER (PARTITION BY rid ORDER BY length(rule) DESC, length(h) DESC, rule DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, COALESCE(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (rid)
""",
    "op8_quality_rules": r"""
WITH t AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM t),
single AS (SELECT rid, UNNEST(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
grams AS (SELECT rid, i, a, LEAD(a) OVER p AS b, LEAD(a, 2) OVER p AS c FROM single WINDOW p AS (PARTITION BY rid ORDER BY i)),
keyed AS (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, a, b, c) AS times FROM grams WHERE c IS NOT NULL),
covered AS (SELECT rid, COUNT(DISTINCT p) AS n FROM (SELECT rid, UNNEST([i, i + 1, i + 2]) AS p FROM keyed WHERE times >= 2) GROUP BY rid),
lines AS (SELECT rid, UNNEST(ls) AS l, generate_subscripts(ls, 1) AS k FROM w),
judged AS (SELECT rid, l, k, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM lines),
stay AS (SELECT rid, SUM(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) AS kept_chars FROM judged WHERE n > 0
  AND regexp_matches(l, '[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}]["'')\]\x{201D}\x{2019}\x{BB}]*[\x20\x09-\x0D]*$')
  AND len(regexp_extract_all(l, '[!?]{2,}')) * 100 <= n * 25
  AND len(regexp_extract_all(l, '[|>\x{BB}\x{203A}\x{2022}\x{B7}]+')) * 100 <= n * 20
  AND len(regexp_extract_all(l, '[#*$%&|<>]')) * 100 <= n * 50
  AND NOT (n <= 30 AND (contains(lower(l), 'licensed under') OR contains(lower(l), 'licenced under') OR contains(lower(l), 'all rights reserved') OR contains(lower(l), 'copyright') OR contains(lower(l), '©') OR contains(lower(l), 'use cookies') OR contains(lower(l), 'accept cookies') OR contains(lower(l), 'cookie policy') OR contains(lower(l), 'privacy policy') OR contains(lower(l), 'terms of use') OR contains(lower(l), 'terms of service') OR contains(lower(l), 'lorem ipsum') OR contains(lower(l), 'enable javascript') OR contains(lower(l), 'subscribe to') OR contains(lower(l), 'sign up for') OR contains(lower(l), 'click here') OR contains(lower(l), 'share on facebook') OR contains(lower(l), 'share on twitter') OR contains(lower(l), 'powered by')))
  GROUP BY rid),
dups AS (SELECT rid, COUNT(*) - COUNT(DISTINCT l) AS n FROM judged WHERE n > 0 GROUP BY rid),
counts AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(COALESCE(dups.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(COALESCE(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(COALESCE(kept_chars, 0) AS BIGINT) AS kept_chars
  FROM w LEFT JOIN covered USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN stay USING (rid))
SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
  NOT (n_words < 50 OR n_repeat_words * 100 > n_words * 50) AND kept_chars * 100 >= word_chars * 50 AS kept FROM counts
""",
    "op12_exact_search": r"""
WITH fit AS (SELECT vec_id, ROW_NUMBER() OVER () AS rid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
entries AS (SELECT vec_id, rid, UNNEST(v) AS x, generate_subscripts(v, 1) AS d FROM fit),
scored AS (SELECT q.vec_id AS query_id, q.rid AS qid, c.vec_id, SUM(q.x * c.x) AS score FROM entries q JOIN entries c ON q.d = c.d AND q.rid <> c.rid
  WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, q.rid, c.vec_id, c.rid),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 5
""",
    "op13_lexical_search": r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS rid, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM d WHERE text IS NOT NULL),
held AS (SELECT rid, w, COUNT(*) AS tf FROM (SELECT rid, UNNEST(ws) AS w FROM words) GROUP BY rid, w),
totals AS (SELECT COUNT(*) AS n_docs, SUM(len(ws)) AS n_terms FROM words WHERE len(ws) > 0),
items AS (SELECT ROW_NUMBER() OVER () AS iid, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
asked AS (SELECT DISTINCT iid, item_id, UNNEST(regexp_extract_all(text, '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS w FROM items),
weighed AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT w, COUNT(*) AS df FROM held GROUP BY w), totals),
sized AS (SELECT rid, doc_id, 100 - 50 + CAST((50 * len(ws) * n_docs) // n_terms AS BIGINT) AS m FROM words, totals WHERE len(ws) > 0),
scored AS (SELECT iid, item_id, rid, doc_id, SUM(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS score
  FROM asked JOIN held USING (w) JOIN weighed USING (w) JOIN sized USING (rid) GROUP BY iid, item_id, rid, doc_id),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50
""",
}
