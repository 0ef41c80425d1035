"""SQL for DuckDB for the queries that SQL can express."""

SQL = {}

#: Repeated runs: a line of 50 words, or two neighbouring lines with words, that stand earlier.
LINE_DEDUP = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM {documents}),
numbered AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM docs),
units AS (
  SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         lead(line) OVER w AS next_line, lead(i) OVER w AS next_i
  FROM numbered WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
windows AS (
  SELECT doc_id, i, NULL AS j, line AS g FROM units WHERE words >= 50
  UNION ALL
  SELECT doc_id, i, next_i, line || chr(10) || next_line FROM units WHERE next_line IS NOT NULL
),
later AS (
  SELECT doc_id, i, j FROM (
    SELECT *, row_number() OVER (PARTITION BY j IS NULL, g ORDER BY doc_id, i) AS nth FROM windows
  ) WHERE nth > 1
),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, i FROM later UNION ALL SELECT doc_id, j FROM later) WHERE i IS NOT NULL),
runs AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM numbered ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
"""

SQL["op3_line_dedup"] = LINE_DEDUP.format(documents="documents") + """
SELECT d.doc_id, coalesce(len(d.lines), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       CASE WHEN d.lines IS NOT NULL THEN md5(coalesce(k.text, '')) END AS text_md5
FROM docs d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_removed, count(DISTINCT run) AS n_runs FROM runs GROUP BY doc_id) r USING (doc_id)
"""

#: Poisson counts by inversion: how many cumulative chances lie at or under a hashed number, summed over parts.
MIXING = r"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM {documents} GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM counts) * 1.0::DOUBLE / ((SELECT count(*)::DOUBLE FROM counts) * n) AS rate FROM counts
),
means AS (SELECT source, greatest(ceil(rate / 32), 1)::INT AS parts, rate / greatest(ceil(rate / 32), 1) AS mean FROM rates),
cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 10 * sqrt(mean) + 20)
),
lists AS (SELECT source, list(c ORDER BY k) AS chances FROM cdf GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.source, md5(d.text) AS text_md5, j, ('0x' || substr(md5('7:' || d.doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM {documents} d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(1, m.parts + 1)) t(j)
),
repeats AS (
  SELECT doc_id, drawn.source, text_md5, sum(len(list_filter(chances, lambda c: c <= u)))::INT AS times
  FROM drawn JOIN lists ON drawn.source IS NOT DISTINCT FROM lists.source GROUP BY doc_id, drawn.source, text_md5
),
mixed AS (
  SELECT doc_id, source, text_md5, copy::INT AS copy, md5('7:order:' || doc_id || ':' || copy) AS mix_key
  FROM repeats, unnest(range(1, times + 1)) t(copy)
)
"""

SQL["op5_mixing"] = MIXING.format(documents="documents") + "SELECT doc_id, source, copy, mix_key, text_md5 FROM mixed"

#: SHA-1 as base32: 160 bits written as a string, read five at a time.
SQL["op6_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS first FROM p),
bits AS (SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: right(bin(('0x' || sha[i + 1])::INT + 16), 4)), 'string_agg', '') AS b FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""

#: Windows of 13 words that also start in a smaller document; what they cover goes.
SQL["op11_substring_dedup"] = r"""
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM docs, unnest(range(1, len(words) - 11)) t(i)),
later AS (SELECT doc_id, i FROM windows JOIN (SELECT w, min(doc_id) AS least FROM windows GROUP BY w) USING (w) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(0, 13)) t(j)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""
