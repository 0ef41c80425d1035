"""The registered queries as SQL for an independent check in DuckDB."""

from docloom.plans.constants import DIM, QUERY_VECTOR, SCORED, TOP_WORDS

SQL = {}

TOKENS = r"""tk AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, text,
  regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+') AS k FROM documents)"""

DOCS = """c AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, d.doc_id, d.text AS content, d.lang, d.source,
  '{"source":"' || d.source || '","lang":"' || d.lang || '","n_chars":' || d.n_chars
    || ',"labeled":' || CASE WHEN l.doc_id IS NULL THEN 'false' ELSE 'true' END
    || ',"stats":{"quality":' || coalesce(CAST(l.quality AS VARCHAR), 'null') || '}}' AS metadata,
  list_concat([d.lang, d.source], list_concat(
    CASE WHEN l.quality = 1 THEN ['hq'] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN l.toxic = 1 THEN ['toxic'] ELSE CAST([] AS VARCHAR[]) END)) AS tags,
  l.doc_id IS NOT NULL AS labeled, l.quality, l.toxic,
  e.embedding AS vector, e.vec_id IS NOT NULL AS is_embedded, 1704067200 + d.doc_id * 60 AS created
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

CSV = "array_to_string(tags, ',')"
WRITTEN = 1735689600  # the write time of the changes, 2025-01-01
FIXED = "CAST(CAST([" + ", ".join(str(x) for x in QUERY_VECTOR) + "] AS FLOAT[]) AS DOUBLE[])"
# A vector that depends on the text: counts of letters, weighted.
LETTERS = "list_transform(range(64), lambda i: CAST(length({0}) - length(replace({0}, chr(CAST(97 + i % 26 AS INTEGER)), '')) AS DOUBLE) * (1 + i // 26))"
STUB = f"list_transform(range({DIM}), lambda i: CAST(CAST(0.1 AS FLOAT) AS DOUBLE))"
WIDE = "CAST({} AS DOUBLE[])"


def rounded(expression, digits=6):
    return f"round({expression}, {digits}) + 0.0"  # + 0.0 turns -0.0 into 0.0


def summary(vector, digits=4):
    return f"CAST(len({vector}) AS INTEGER) AS dim, {rounded(f'list_sum(CAST({vector} AS DOUBLE[]))', digits)} AS total"


def bm25(words, condition, extra_ctes=""):
    """CTEs up to ``sc(id, score)`` for single words, over ``tk``."""
    dfs = ", ".join(
        f"CAST(count(*) FILTER (WHERE list_contains(k, '{w}')) AS DOUBLE) AS df_{i}" for i, w in enumerate(words)
    )
    idfs = ", ".join(
        f"CASE WHEN ln((n_docs - df_{i} + 0.5::DOUBLE) / (df_{i} + 0.5::DOUBLE)) > 0"
        f" THEN ln((n_docs - df_{i} + 0.5::DOUBLE) / (df_{i} + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS idf_{i}"
        for i in range(len(words))
    )
    tfs = ", ".join(f"CAST(len(list_filter(k, lambda x: x = '{w}')) AS DOUBLE) AS tf_{i}" for i, w in enumerate(words))
    parts = " + ".join(
        f"CASE WHEN tf_{i} > 0 THEN idf_{i} * (tf_{i} * 2.2::DOUBLE / (tf_{i} + 1.2::DOUBLE *"
        f" (0.25::DOUBLE + 0.75::DOUBLE * len(k) / mean_length))) ELSE 0 END"
        for i in range(len(words))
    )
    return f"""{TOKENS}{extra_ctes},
 st AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, CAST(sum(len(k)) AS DOUBLE) / count(*) AS mean_length, {dfs} FROM tk),
 w AS (SELECT mean_length, {idfs} FROM st),
 f AS (SELECT id, k, {tfs} FROM tk WHERE {condition}),
 sc AS (SELECT id, -(0.0::DOUBLE + {parts}) AS score FROM f, w)"""


def has_any(words):
    return "list_has_any(k, [" + ", ".join(f"'{w}'" for w in words) + "])"


def phrase_at(*words):
    return (
        "SELECT a.id, a.p FROM pos a "
        + " ".join(f"JOIN pos b{i} ON b{i}.id = a.id AND b{i}.p = a.p + {i} AND b{i}.t = '{w}'" for i, w in enumerate(words) if i)
        + f" WHERE a.t = '{words[0]}'"
    )


POSITIONS = "pos AS (SELECT id, unnest(k) AS t, generate_subscripts(k, 1) - 1 AS p FROM tk)"

# -- tokenizer and match conditions

SQL["tokenize_counts"] = f"""WITH {TOKENS} SELECT id, CAST(len(k) AS INTEGER) AS n_tokens,
  CAST(len(list_distinct(k)) AS INTEGER) AS n_distinct FROM tk"""
SQL["match_term"] = f"WITH {TOKENS} SELECT id FROM tk WHERE list_contains(k, 'esat')"
SQL["match_all"] = f"WITH {TOKENS} SELECT id FROM tk WHERE list_has_all(k, ['of', 'estion'])"
SQL["match_any"] = f"WITH {TOKENS} SELECT id FROM tk WHERE list_has_any(k, ['der', 'que', 'esat'])"
SQL["match_not"] = f"WITH {TOKENS} SELECT id FROM tk WHERE list_contains(k, 'the') AND NOT list_contains(k, 'of')"
SQL["match_phrase"] = f"WITH {TOKENS}, {POSITIONS} SELECT DISTINCT id FROM ({phrase_at('the', 'of')})"
SQL["match_prefix"] = f"WITH {TOKENS} SELECT id FROM tk WHERE len(list_filter(k, lambda x: starts_with(x, 'estio'))) > 0"
SQL["match_near"] = f"""WITH {TOKENS}, {POSITIONS} SELECT DISTINCT a.id FROM pos a JOIN pos b ON a.id = b.id
  WHERE a.t = 'esat' AND b.t = 'the' AND abs(a.p - b.p) - 1 <= 3"""
SQL["match_initial"] = f"WITH {TOKENS} SELECT id FROM tk WHERE k[1] = 'the'"

# -- ranked text search

SQL["bm25_scores"] = f"WITH {bm25(SCORED, has_any(SCORED))} SELECT id, {rounded('score')} AS score FROM sc"
_TOP = """SELECT id, {score} AS score, CAST(rank AS INTEGER) AS rank FROM
  (SELECT id, score, row_number() OVER (ORDER BY score, id) AS rank FROM sc) WHERE rank <= {k}"""
SQL["fulltext_topk"] = f"WITH {bm25(TOP_WORDS, has_any(TOP_WORDS))} " + _TOP.format(score=rounded("score"), k=10)
SQL["fulltext_postings"] = SQL["fulltext_topk"]
SQL["fulltext_ranked_all"] = f"""WITH {bm25(TOP_WORDS, has_any(TOP_WORDS))}, r AS (SELECT id, {rounded("score")} AS score FROM sc)
 SELECT id, score, CAST(row_number() OVER (ORDER BY score, id) AS INTEGER) AS rank FROM r"""
SQL["hydrate_hits"] = f"""WITH {bm25(TOP_WORDS, has_any(TOP_WORDS))}, {DOCS}
 SELECT c.id, CAST(rank AS INTEGER) AS rank, md5(content) AS content, {CSV} AS tags, is_embedded
 FROM (SELECT id, row_number() OVER (ORDER BY score, id) AS rank FROM sc) JOIN c USING (id) WHERE rank <= 10"""
SQL["fulltext_filtered"] = (
    f"WITH {bm25(TOP_WORDS, has_any(TOP_WORDS) + ' AND id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)')} "
    + _TOP.format(score=rounded("score"), k=20)
)
SQL["filtered_postings"] = SQL["fulltext_filtered"]


def word_scores(queries):
    """CTEs up to ``hit(query_id, id, total, n_found, n_words)`` for a table of
    query texts: the sum of word contributions per query and document."""
    return rf"""{TOKENS}, q AS ({queries}),
 qw AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id,
   unnest(regexp_extract_all(strip_accents(lower(query)), '[\p{{L}}\p{{N}}\p{{Co}}]+')) AS word FROM q) GROUP BY ALL),
 nw AS (SELECT query_id, count(*) AS n_words FROM qw GROUP BY ALL),
 tf AS (SELECT id, word, n, count(*) AS tf FROM (SELECT id, len(k) AS n, unnest(k) AS word FROM tk) GROUP BY ALL),
 df AS (SELECT word, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY ALL),
 st AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, CAST(sum(len(k)) AS DOUBLE) / count(*) AS mean_length FROM tk),
 wt AS (SELECT query_id, word, times * CASE WHEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0
   THEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END AS weight
   FROM qw JOIN df USING (word), st),
 hit AS (SELECT query_id, id, sum(weight * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean_length)))
   ) AS total, count(*) AS n_found, any_value(n_words) AS n_words
   FROM wt JOIN tf USING (word) JOIN nw USING (query_id), st GROUP BY query_id, id)"""


SQL["fulltext_batch"] = f"""WITH {word_scores("SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark")}
 SELECT query_id, id, {rounded('-total')} AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY round(total, 9) DESC, id) AS rank FROM hit) WHERE rank <= 10"""

# -- postings

SQL["batch_postings"] = SQL["fulltext_batch"]
SQL["postings_build"] = f"""WITH {TOKENS}, {POSITIONS} SELECT t AS term, id, CAST(count(*) AS INTEGER) AS tf,
  CAST(any_value(n) AS INTEGER) AS length, CAST(sum(p) AS INTEGER) AS position_sum
  FROM pos JOIN (SELECT id, len(k) AS n FROM tk) USING (id) GROUP BY t, id"""
SQL["phrase_postings"] = f"""WITH {TOKENS}, {POSITIONS},
 ph AS (SELECT id, count(*) AS tf FROM ({phrase_at('the', 'of')}) GROUP BY id),
 pr AS (SELECT id, count(*) AS tf FROM pos WHERE starts_with(t, 'estio') GROUP BY id),
 st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(k)) AS DOUBLE) / count(*) AS mean_length FROM tk),
 w AS (SELECT mean_length, greatest(ln((n - a + 0.5) / (a + 0.5)), 1e-6) AS wa, greatest(ln((n - b + 0.5) / (b + 0.5)), 1e-6) AS wb
  FROM st, (SELECT count(*) AS a FROM ph), (SELECT count(*) AS b FROM pr))
 SELECT id, {rounded('''-(wa * ph.tf * 2.2 / (ph.tf + 1.2 * (0.25 + 0.75 * len(k) / mean_length))
   + wb * pr.tf * 2.2 / (pr.tf + 1.2 * (0.25 + 0.75 * len(k) / mean_length)))''')} AS score
 FROM ph JOIN pr USING (id) JOIN tk USING (id), w"""
SQL["postings_incremental"] = r"""WITH tk AS (SELECT d.doc_id, regexp_extract_all(strip_accents(lower(
   CASE WHEN l.doc_id IS NULL THEN text ELSE text || ' revised edition ' || lang END)), '[\p{L}\p{N}\p{Co}]+') AS k
   FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) <> 1)
 SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest(k) AS term FROM tk) GROUP BY term"""

SQL["fulltext_early"] = SQL["fulltext_topk"]


def matching_score(places):
    """BM25 of one leaf from the documents and counts ``hit(id, tf)``."""
    return f"""WITH {TOKENS}, {POSITIONS}, hit AS ({places}),
 st AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(len(k)) AS DOUBLE) / count(*) AS mean_length FROM tk),
 w AS (SELECT mean_length, greatest(ln((n - a + 0.5) / (a + 0.5)), 1e-6) AS wa FROM st, (SELECT count(*) AS a FROM hit))
 SELECT id, {rounded('-(wa * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(k) / mean_length)))')} AS score
 FROM hit JOIN tk USING (id), w"""


SQL["prefix_postings"] = matching_score("SELECT id, count(*) AS tf FROM pos WHERE starts_with(t, 'estio') GROUP BY id")
SQL["near_postings"] = f"""WITH {bm25(["esat", "the"], "list_has_all(k, ['esat', 'the'])")}, {POSITIONS}
 SELECT id, {rounded('score')} AS score FROM sc WHERE id IN (SELECT a.id FROM pos a JOIN pos b ON a.id = b.id
  WHERE a.t = 'esat' AND b.t = 'the' AND abs(a.p - b.p) - 1 <= 3)"""

# -- filters

SQL["filter_tag"] = "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang = 'fr'"
SQL["filter_tags_all"] = f"WITH {DOCS} SELECT id FROM c WHERE list_has_all(tags, ['en', 'hq'])"
SQL["filter_meta_string"] = f"WITH {DOCS} SELECT id FROM c WHERE json_extract_string(metadata, '$.lang') = 'de'"
SQL["filter_meta_number"] = """SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
  AND CAST(json_extract_string(props, '$.k') AS DOUBLE) = 42"""
SQL["filter_meta_bool"] = f"WITH {DOCS} SELECT id FROM c WHERE json_extract_string(metadata, '$.labeled') = 'true'"
SQL["filter_meta_object"] = f"""WITH {DOCS} SELECT id FROM c WHERE CAST(json_extract(metadata, '$.stats') AS VARCHAR) = '{{"quality":1}}'"""
SQL["filter_meta_nested"] = f"WITH {DOCS} SELECT id FROM c WHERE json_extract_string(metadata, '$.stats.quality') = '0'"
SQL["filter_combined"] = f"WITH {DOCS} SELECT id FROM c WHERE lang = 'en' AND source = 'src7' AND NOT labeled"

_SAME = """a.labeled AND a.lang = b.lang AND a.source = b.source AND length(a.content) = length(b.content)
   AND b.labeled AND a.quality = b.quality"""
SQL["filter_many"] = f"WITH {DOCS} SELECT b.id, a.id AS filter_no FROM c a JOIN c b ON {_SAME}"

# -- reading

SQL["get_documents"] = f"""WITH {DOCS} SELECT id, CAST(length(content) AS INTEGER) AS n_chars, is_embedded, {CSV} AS tags
  FROM c WHERE labeled"""
SQL["list_page"] = f"""WITH {DOCS} SELECT id, created AS created_at, {CSV} AS tags, is_embedded FROM c
  ORDER BY created DESC, id LIMIT 100 OFFSET 50"""
SQL["list_page_deep"] = f"""WITH {DOCS} SELECT id, created AS created_at, {CSV} AS tags, is_embedded FROM c
  ORDER BY created DESC, id LIMIT 40 OFFSET 150"""
SQL["project_minimal"] = f"WITH {DOCS} SELECT id, created AS created_at, created AS updated_at, is_embedded FROM c"
SQL["project_none"] = "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents"
SQL["project_full"] = f"""WITH {DOCS} SELECT id, md5(content) AS content, metadata, {CSV} AS tags, {summary('vector')} FROM c"""
SQL["pending_embeddings"] = f"""WITH {DOCS} SELECT id, created AS created_at FROM c WHERE NOT is_embedded
  ORDER BY created, id LIMIT 100"""
SQL["collection_stats"] = f"""WITH {DOCS} SELECT source AS db, count(*) AS document_count,
  count(*) FILTER (WHERE is_embedded) AS embedded_count, min(created) AS created_at, max(created) AS last_updated
  FROM c GROUP BY source"""

# -- changes

BATCH = """b AS (SELECT id, content || ' revised edition ' || lang AS content, [lang, 'revised'] AS tags FROM c WHERE labeled
  UNION ALL SELECT 'b' || item_id, text, ['new'] FROM benchmark)"""
UPSERTED = f"""u AS (SELECT coalesce(b.id, c.id) AS id, coalesce(b.content, c.content) AS content, coalesce(b.tags, c.tags) AS tags,
  coalesce(c.created, {WRITTEN}) AS created_at, CASE WHEN b.id IS NULL THEN c.created ELSE {WRITTEN} END AS updated_at,
  b.id IS NULL AND c.is_embedded AS is_embedded, coalesce(c.is_embedded, false) AS was_embedded
  FROM c FULL OUTER JOIN b ON c.id = b.id)"""
DOOMED = """x AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM labels WHERE toxic = 1
  UNION ALL SELECT 'b' || item_id FROM benchmark)"""
_CHANGED = f"id, md5(content) AS content, {CSV} AS tags, created_at, updated_at, is_embedded"
SQL["upsert_documents"] = f"WITH {DOCS}, {BATCH}, {UPSERTED} SELECT {_CHANGED} FROM u"
SQL["upsert_unembeds"] = f"WITH {DOCS}, {BATCH}, {UPSERTED} SELECT id, true AS cleared FROM u WHERE was_embedded AND NOT is_embedded"
SQL["delete_documents"] = f"WITH {DOCS}, {DOOMED} SELECT id FROM c WHERE id NOT IN (SELECT id FROM x)"
SQL["delete_not_found"] = f"WITH {DOCS}, {DOOMED} SELECT DISTINCT id FROM x WHERE id NOT IN (SELECT id FROM c)"
SQL["update_vectors"] = f"""WITH {DOCS} SELECT id, is_embedded, CASE WHEN is_embedded THEN {WRITTEN} ELSE created END AS updated_at,
  {summary('vector')} FROM c"""
SQL["upsert_missing_ids"] = "SELECT count(*) AS n, count(*) AS n_ids, count(DISTINCT conv_id || '/' || turn || '/' || coalesce(text, '')) AS n_texts FROM conversations"
SQL["assign_ids"] = "SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_uuid FROM conversations"

# -- ingest

SQL["ingest_valid"] = f"""WITH {DOCS} SELECT id, md5(content) AS content, '{{"test":true}}' AS metadata, {CSV} AS tags,
  false AS is_embedded FROM c WHERE source <> 'src7' AND coalesce(toxic, 0) <> 1"""
SQL["ingest_rejected"] = f"""WITH {DOCS} SELECT CASE WHEN source = 'src7' THEN 'invalid request body' ELSE 'content is required' END
  AS reason, count(*) AS n FROM c WHERE source = 'src7' OR toxic = 1 GROUP BY ALL"""
SQL["ingest_wrong_kinds"] = """SELECT CASE WHEN doc_id % 5 = 3 THEN 'stored' ELSE 'invalid request body' END AS reason, count(*) AS n
  FROM documents GROUP BY ALL"""
SQL["ingest_embed_sync"] = f"SELECT CAST(doc_id AS VARCHAR) AS id, true AS is_embedded, {summary(LETTERS.format('text'))} FROM documents"
SQL["embed_failures"] = """SELECT CAST(doc_id AS VARCHAR) AS id, NOT starts_with(text, 'E') AS done,
  CASE WHEN starts_with(text, 'E') THEN 'begins with E' END AS error FROM documents"""
SQL["ingest_embed_async"] = "SELECT CAST(doc_id AS VARCHAR) AS id, false AS is_embedded, true AS cleared FROM documents"
SQL["tags_from_csv"] = f"""WITH {DOCS} SELECT id, {CSV} AS csv, CAST(len(string_split({CSV}, ',')) AS INTEGER) AS n_tags,
  string_split({CSV}, ',')[-1] AS last_tag FROM c"""

SQL["parsed_times"] = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_ms(date_trunc('second', ts))
  WHEN 1 THEN epoch_ms(date_trunc('second', ts)) + 250 - 7200000 END AS millis FROM events"""

# -- embedding

SQL["embed_stub"] = f"""SELECT CAST(doc_id AS VARCHAR) AS id, 2560 AS dim,
  {rounded('2560 * CAST(CAST(0.1 AS FLOAT) AS DOUBLE)', 4)} AS total FROM documents"""
SQL["embed_custom"] = """SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS DOUBLE) AS v0,
  CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS v1,
  CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS v2 FROM documents"""
SQL["embedding_backfill"] = f"""WITH {DOCS}, p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY created, id) AS place
  FROM c WHERE NOT is_embedded)
 SELECT 'main' AS db, lang AS "table", id, {DIM} AS dim FROM p WHERE place <= 15 ORDER BY lang, created, id LIMIT 15"""
SQL["backfill_all"] = f"""WITH {DOCS} SELECT 'main' AS db, lang AS "table", id, {summary(LETTERS.format('content'))} FROM c WHERE NOT is_embedded"""
# Cycles of 20: two tries for each of the failing documents at the head of the queue.
SQL["backfill_with_failures"] = f"""WITH RECURSIVE {DOCS}, pending AS (SELECT id, starts_with(content, 'E') AS bad,
   row_number() OVER (ORDER BY created, id) AS place FROM c WHERE NOT is_embedded),
 cycle AS (
   SELECT 0 AS nth, list({{'id': id, 'bad': bad, 'tries': 0, 'done': false}} ORDER BY place) AS queue FROM pending
   UNION ALL
   SELECT nth + 1, list_transform(queue, lambda x, i: CASE
     WHEN x.done OR x.tries >= 2 OR len(list_filter(queue[1:i], lambda y: NOT y.done AND y.tries < 2)) > 20 THEN x
     WHEN x.bad THEN {{'id': x.id, 'bad': x.bad, 'tries': x.tries + 1, 'done': false}}
     ELSE {{'id': x.id, 'bad': x.bad, 'tries': x.tries, 'done': true}} END) FROM cycle WHERE nth < 5),
 last AS (SELECT unnest(queue) AS x FROM cycle WHERE nth = 5)
 SELECT c.id, c.is_embedded OR coalesce(x.done, false) AS is_embedded, CASE WHEN x.tries > 0 THEN CAST(x.tries AS BIGINT) END AS tries,
   CASE WHEN x.tries > 0 THEN 'begins with E' END AS error FROM c LEFT JOIN last ON c.id = x.id"""
SQL["embedding_payloads"] = f"""SELECT vec_id, CASE WHEN label % 5 < 3 THEN {DIM} END AS dim,
  CASE WHEN label % 5 < 3 THEN {rounded('list_sum(CAST(embedding AS DOUBLE[]))', 4)} END AS total,
  CASE label % 5 WHEN 3 THEN 'dimension is not {DIM} but 3' WHEN 4 THEN 'unreadable' END AS error FROM embeddings"""

# -- vectors

V = "CAST(embedding AS DOUBLE[])"
VECS = "v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
COSINE = "list_cosine_similarity({}, {})"


def nearest(source, score, k):
    return f"""WITH {source}, s AS (SELECT id, {score} AS score FROM v)
 SELECT id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s)
 WHERE rank <= {k}"""


_COS, _EUC, _DOT = (
    rounded(e) for e in (COSINE.format("x", FIXED), f"-list_distance(x, {FIXED})", f"list_inner_product(x, {FIXED})")
)
SQL["vec_cosine"] = f"WITH {VECS} SELECT id, {_COS} AS score FROM v"
SQL["vec_euclidean"] = f"WITH {VECS} SELECT id, {_EUC} AS score FROM v"
SQL["vec_dot"] = f"WITH {VECS} SELECT id, {_DOT} AS score FROM v"
SQL["vector_topk"] = nearest(VECS, _COS, 10)
SQL["metric_fallback"] = SQL["vector_topk"]
SQL["vector_topk_euclidean"] = nearest(VECS, _EUC, 10)
SQL["vector_ranked"] = nearest(VECS, _DOT, "rank")
SQL["vector_filtered"] = nearest(
    f"{DOCS}, v AS (SELECT id, CAST(vector AS DOUBLE[]) AS x FROM c WHERE is_embedded AND lang = 'en' AND labeled)", _COS, 20
)
SQL["knn_join"] = f"""WITH {VECS}, s AS (SELECT a.id AS query_id, b.id AS id, {rounded(COSINE.format('a.x', 'b.x'))} AS score
  FROM v a, v b) SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""
SQL["knn_pivots"] = SQL["knn_join"]
SQL["vector_text_query"] = f"""WITH {VECS}, b AS (SELECT item_id, {LETTERS.format('text')} AS y FROM benchmark),
  s AS (SELECT item_id, id, {rounded(COSINE.format('x', 'y'))} AS score FROM v, b),
  t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM s)
 SELECT CAST(item_id AS VARCHAR) AS query_id, id, score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= 10"""
SQL["vector_dim_report"] = f"""WITH {DOCS} SELECT CAST(coalesce(len(vector), 0) AS INTEGER) AS dim, count(*) AS n,
  coalesce(len(vector), 0) = {DIM} AS as_expected FROM c GROUP BY ALL"""
SQL["vector_blob_roundtrip"] = f"""SELECT CAST(vec_id AS VARCHAR) AS id, CAST(4 * len(embedding) AS INTEGER) AS n_bytes,
  {summary('embedding')} FROM embeddings"""

# -- the search front

_ASKED = """SELECT CAST(item_id AS VARCHAR) AS query_id, CASE WHEN item_id % 7 = 3 THEN '' ELSE text END AS query,
  ['fulltext', 'vector', 'hybrid', '', 'fuzzy'][item_id % 5 + 1] AS type,
  CASE WHEN item_id % 2 = 0 THEN 5 ELSE 10 END AS k, item_id % 3 = 0 AS english FROM benchmark"""
_OPEN = f"""SELECT query_id, query, CASE type WHEN '' THEN 'fulltext' ELSE type END AS type, k, english FROM ({_ASKED})
  WHERE query <> '' AND type <> 'fuzzy'"""
ANSWERS = f"""{word_scores(_OPEN)}, {DOCS},
 text_hit AS (SELECT query_id, type, k, id, total, CASE WHEN type = 'hybrid' AND is_embedded
    THEN round({COSINE.format('CAST(vector AS DOUBLE[])', LETTERS.format('query'))}, 9) END AS cosine
  FROM hit JOIN q USING (query_id) JOIN c USING (id)
  WHERE n_found = n_words AND type IN ('fulltext', 'hybrid') AND (NOT english OR c.lang = 'en')),
 ranked AS (SELECT query_id, type, k, id, CASE type WHEN 'hybrid' THEN cosine ELSE -total END AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC NULLS LAST,
      round(total, 9) DESC, id) AS rank FROM text_hit),
 vector_hit AS (SELECT query_id, type, k, id, round({COSINE.format('CAST(vector AS DOUBLE[])', LETTERS.format('query'))}, 9) AS score
  FROM q, c WHERE type = 'vector' AND is_embedded AND (NOT english OR c.lang = 'en')),
 answers AS (SELECT query_id, type, id, score, rank FROM ranked WHERE rank <= k
  UNION ALL SELECT query_id, type, id, score, rank FROM (SELECT *, row_number() OVER
    (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vector_hit) WHERE rank <= k)"""
SQL["search_requests"] = f"""WITH {ANSWERS} SELECT query_id, type, id, {rounded('score')} AS score, CAST(rank AS INTEGER) AS rank
  FROM answers"""
_KINDS = """SELECT CAST(item_id AS VARCHAR) AS query_id, item_id % 6 AS n,
  CASE item_id % 6 WHEN 0 THEN 'esat lich que' WHEN 4 THEN 'que' ELSE 'the' END AS query FROM benchmark"""
SQL["search_match_kinds"] = f"""WITH {word_scores(_KINDS)}, ok AS (SELECT hit.*, q.n FROM hit JOIN q USING (query_id) JOIN tk USING (id) WHERE CASE q.n
   WHEN 0 THEN true WHEN 1 THEN NOT list_contains(k, 'of') WHEN 2 THEN contains(' ' || array_to_string(k, ' ') || ' ', ' the of ')
   WHEN 3 THEN len(list_filter(k, lambda x: starts_with(x, 'estio'))) > 0 WHEN 4 THEN NOT list_contains(k, 'de') ELSE false END)
 SELECT query_id, id, {rounded('-total')} AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY round(total, 9) DESC, id) AS rank FROM ok) WHERE rank <= 7
 UNION ALL SELECT query_id, 'invalid filters', NULL, 0 FROM ({_KINDS}) WHERE n = 5"""
SQL["search_many_filters"] = f"""WITH {word_scores("SELECT 'q' AS query_id, 'the of' AS query")}, {DOCS},
 ok AS (SELECT a.id AS query_id, b.id, total FROM c a JOIN c b ON {_SAME} JOIN hit ON hit.id = b.id JOIN tk ON tk.id = b.id WHERE list_contains(k, 'the'))
 SELECT query_id, id, {rounded('-total')} AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY round(total, 9) DESC, id) AS rank FROM ok) WHERE rank <= 3"""
SQL["requests_postings"] = SQL["search_requests"]
SQL["match_kinds_postings"] = SQL["search_match_kinds"]
SQL["many_filters_postings"] = SQL["search_many_filters"]
SQL["search_rejected"] = f"""SELECT query_id, CASE WHEN query = '' THEN 'query is required'
  ELSE 'invalid search type: fuzzy' END AS reason FROM ({_ASKED}) WHERE query = '' OR type = 'fuzzy'"""
SQL["search_response"] = f"""WITH {ANSWERS} SELECT query_id, q.type, CAST(count(id) AS INTEGER) AS total,
  coalesce(string_agg(id, ',' ORDER BY rank), '') AS ids FROM q LEFT JOIN answers USING (query_id) GROUP BY query_id, q.type"""
SQL["hybrid_topk"] = f"""WITH {bm25(TOP_WORDS, has_any(TOP_WORDS))}, {DOCS},
 h AS (SELECT id, {rounded(COSINE.format('CAST(vector AS DOUBLE[])', FIXED))} AS score, sc.score AS text_score
  FROM sc JOIN c USING (id))
 SELECT id, score, {rounded('text_score')} AS text_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER
  (ORDER BY score DESC NULLS LAST, text_score, id) AS rank FROM h) WHERE rank <= 20"""

# -- stored collections and streams

SQL["stored_collection"] = f"""WITH {DOCS}, {BATCH}, {DOOMED}, s AS (SELECT coalesce(b.id, c.id) AS id, coalesce(b.content, c.content) AS content,
  coalesce(b.tags, c.tags) AS tags, coalesce(c.created, {WRITTEN}) AS created_at, {WRITTEN} AS updated_at,
  b.id IS NULL AND c.is_embedded AS is_embedded FROM c FULL OUTER JOIN b ON c.id = b.id)
 SELECT {_CHANGED} FROM s WHERE id NOT IN (SELECT id FROM x)"""
SQL["stream_upsert"] = f"""WITH {DOCS} SELECT id, md5(content) AS content, {CSV} AS tags, {WRITTEN} AS created_at,
  {WRITTEN} AS updated_at, false AS is_embedded FROM c"""
SQL["stream_backfill"] = f"""WITH {DOCS}, f AS (SELECT id, CASE WHEN is_embedded THEN CAST(vector AS DOUBLE[]) ELSE {LETTERS.format('content')} END AS x FROM c)
 SELECT id, true AS is_embedded, {summary('x')} FROM f"""
SQL["backfill_tables"] = f"""WITH {DOCS}, p AS (SELECT *, CASE lang WHEN 'en' THEN 'english' ELSE 'other' END AS t,
   row_number() OVER (PARTITION BY CASE lang WHEN 'en' THEN 'english' ELSE 'other' END ORDER BY is_embedded, created, id) AS place FROM c),
 d AS (SELECT id FROM p WHERE place <= 15 AND NOT is_embedded ORDER BY t, created, id LIMIT 15)
 SELECT t AS "table", id, is_embedded OR id IN (SELECT id FROM d) AS is_embedded FROM p"""
SQL["backfill_queue"] = """SELECT 'docs' AS "table", CAST(doc_id AS VARCHAR) AS id, md5(text || ' revised edition ' || lang) AS content
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""
SQL["database_list"] = f"""WITH {DOCS} SELECT coalesce(lang, 'none') AS name, count(*) + count(*) FILTER (WHERE labeled) AS document_count,
  count(*) FILTER (WHERE is_embedded) AS embedded_count, least(min(created), {WRITTEN}) AS created_at, {WRITTEN} AS last_updated,
  true AS stored FROM c GROUP BY 1 UNION ALL SELECT 'gone', 0, 0, NULL, NULL, false"""
SQL["collection_get"] = "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS content FROM documents WHERE doc_id IN (7, 42, 199)"
SQL["index_refresh"] = SQL["postings_incremental"]
SQL["stream_index"] = r"""WITH tk AS (SELECT d.doc_id, regexp_extract_all(strip_accents(lower(
   CASE WHEN l.doc_id IS NULL THEN text ELSE text || ' revised edition ' || lang END)), '[\p{L}\p{N}\p{Co}]+') AS k
   FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
 SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest(k) AS term FROM tk) GROUP BY term"""
SQL["stream_last_wins"] = """SELECT CAST(doc_id AS VARCHAR) AS id, md5('last ' || text) AS content FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels)"""
