"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5(coalesce(cast(doc_id AS varchar), 'null') || ':7') AS h
  FROM documents
), s AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, 3 * source_size AS cap,
         cast(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS double)
         / cast(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS double) AS level
  FROM s
  WINDOW b AS (ORDER BY 3 * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cast(cap AS double), (SELECT max(level) FROM l) * w) AS target FROM l
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN cast(floor(target / source_size) AS bigint) ELSE 0 END AS whole FROM t
), v AS (
  SELECT *, greatest(0, cast(floor(target) AS bigint) - whole * source_size) AS want FROM u
), g AS (
  SELECT source, h, sum(size) AS n, count(*) AS k FROM d GROUP BY source, h
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) - n AS before FROM g
)
SELECT d.doc_id, cast(d.size AS bigint) AS size, v.source_size, v.target,
       cast(v.whole * d.size + CASE WHEN r.before + r.n <= v.want THEN d.size
            WHEN r.before <= v.want THEN least(d.size, (v.want - r.before) // r.k) ELSE 0 END AS bigint) AS taken
FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source
JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h
"""

OP10 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
  FROM documents
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], chr(1)) AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)
), a AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, i + unnest(range(0, 8)) AS p
    FROM (SELECT *, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1) GROUP BY rid
), li AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{WORD}') GROUP BY rid
), m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(a.n, 0) AS n_repeat_words,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
         length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_letters,
         len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) AS n_alpha
  FROM d LEFT JOIN a USING (rid) LEFT JOIN li USING (rid)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars,
       cast(n_symbols AS bigint) AS n_symbols, cast(n_dup_lines AS bigint) AS n_dup_lines,
       cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_alpha < 7 * n_words OR 10 * n_upper > 4 * n_letters) AS kept
FROM f
"""

OP7 = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT rid, p, md5(substr(h, 2 * p + 1, 400)) AS k
  FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d)
), r AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1
), g AS (
  SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run FROM (
    SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM r)
), s AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before
  FROM (SELECT rid, run, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY rid, run)
), k AS (
  SELECT rid, count(*) AS n, sum(b - a) AS gone, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM s JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, cast(len(h) // 2 AS bigint) AS n_bytes, cast(coalesce(gone, 0) AS bigint) AS n_removed,
       cast(coalesce(n, 0) AS bigint) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""

ORACLES = {"op6_source_mixing": OP6, "op7_substring_dedup": OP7, "op10_quality_rules": OP10}
