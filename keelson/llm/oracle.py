"""DuckDB SQL for the queries that SQL can express."""

_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": rf"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, i, a[i] AS line FROM cut, unnest(range(1, len(a) + 1)) AS u(i)),
keyed AS (SELECT doc_id, i, line, {_KEY} AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (o.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o ON keyed.k = o.k GROUP BY doc_id""",
    "op3_cover_dedup": rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM docs, unnest(range(1, len(w) - 11)) AS u(i)),
first AS (SELECT h, min(doc_id) AS lead FROM windows GROUP BY h),
again AS (SELECT doc_id, i FROM windows JOIN first USING (h) WHERE doc_id > lead),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, range(0, 13) AS r(k)),
words AS (SELECT doc_id, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) AS u(p)),
sums AS (SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (g.p IS NULL) AS kept
         FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN sums USING (doc_id)""",
}
