"""The registered queries: every operator over whole test tables.

Values come out rounded, arrays as text or as length and sum, and times as
epoch seconds, so that two engines can be compared row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.filters import filter_column
from docloom.functions.payloads import parse_payload
from docloom.functions.tags import tags_from_csv, tags_to_csv
from docloom.functions.text import tokens, with_tokens
from docloom.functions.times import parse_time
from docloom.functions.vectors import blob_to_vector, similarity, vector_to_blob
from docloom.operators import embed, filter_join, fulltext, listing, match, mutate, postings, search, text_batch, vector
from docloom.operators.vector_index import VectorIndex
from docloom.plans.constants import AS_OF, DIM, QUERY_VECTOR, SCORED, TOP_WORDS
from docloom.session import shared_dir, shuffles_removed
from docloom.sources import ingest
from docloom.sources.collection import Collection, list_databases
from docloom.sources.tables import collection, load, texts, vectors
from docloom.streaming.jobs import read_failures, run_backfill, stream_backfill, stream_upserts

QUERIES = {}


def query(fn, name=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[name or fn.__name__] = run
    return run


def _score(column="score"):
    return F.round(column, 6).alias(column)


def _seconds(column):
    return F.unix_timestamp(column).alias(column)


def _vector_summary(column="vector"):
    total = F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.size(column).alias("dim"), F.round(total, 4).alias("total")


# -- tokenizer and match conditions


@query
def tokenize_counts(spark, sf_dir):
    docs = with_tokens(texts(spark, sf_dir))
    return docs.select("id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


def _matching(name, condition):
    def run(spark, sf_dir):
        return fulltext.match_text(texts(spark, sf_dir), condition).select("id")

    return query(run, name)


_matching("match_term", match.term("Esat"))
_matching("match_all", match.all_of("of", "estion"))
_matching("match_any", match.any_of("der", "que", "esat"))
_matching("match_not", match.term("the").but_not(match.term("of")))
_matching("match_phrase", match.phrase("the", "of"))
_matching("match_prefix", match.prefix("estio"))
_matching("match_near", match.near("esat", "the", distance=3))
_matching("match_initial", match.initial("the"))


# -- ranked text search


@query
def bm25_scores(spark, sf_dir):
    scored = fulltext.score_text(texts(spark, sf_dir), match.any_of(*SCORED))
    return scored.select("id", _score())


@query
def fulltext_topk(spark, sf_dir):
    hits = fulltext.search_text(texts(spark, sf_dir), match.any_of(*TOP_WORDS), 10)
    return hits.select("id", _score(), "rank")


@query
def fulltext_ranked_all(spark, sf_dir):
    """Without a limit, every match gets its rank."""
    scored = fulltext.score_text(texts(spark, sf_dir), match.any_of(*TOP_WORDS)).withColumn("score", F.round("score", 6))
    return fulltext.best(scored, None).select("id", "score", F.col("rank").cast("int").alias("rank"))


@query
def hydrate_hits(spark, sf_dir):
    docs = collection(spark, sf_dir)
    hits = fulltext.search_text(docs.select("id", "content"), match.any_of(*TOP_WORDS), 10).select("id", "rank")
    whole = fulltext.hydrate(hits, docs)
    return whole.select("id", "rank", F.md5("content").alias("content"), tags_to_csv("tags").alias("tags"), "is_embedded")


@query
def fulltext_filtered(spark, sf_dir):
    docs = collection(spark, sf_dir, with_vectors=False)
    hits = fulltext.search_text(docs, match.any_of(*TOP_WORDS), 20, {"tag": "hq", "labeled": True})
    return hits.select("id", _score(), "rank")


def _passages(spark, sf_dir):
    """Every passage as one query text."""
    passages = load(spark, sf_dir, "benchmark")
    return passages.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


@query
def fulltext_batch(spark, sf_dir):
    hits = text_batch.search_text_batch(_passages(spark, sf_dir), texts(spark, sf_dir), 10, digits=9)
    return hits.select("query_id", "id", _score(), "rank")


# -- postings


@query
def postings_build(spark, sf_dir):
    positions = F.aggregate("positions", F.lit(0), lambda acc, p: acc + p).alias("position_sum")
    return postings.build_postings(texts(spark, sf_dir)).select("term", "id", "tf", "length", positions)


def _stored_index(spark, sf_dir):
    return postings.TextIndex.build(texts(spark, sf_dir)).write(shared_dir(spark, "index"))


@query
def fulltext_postings(spark, sf_dir):
    hits = _stored_index(spark, sf_dir).search(match.any_of(*TOP_WORDS), 10)
    return hits.select("id", _score(), "rank")


@query
def batch_postings(spark, sf_dir):
    hits = _stored_index(spark, sf_dir).search_batch(_passages(spark, sf_dir), 10, digits=9)
    return hits.select("query_id", "id", _score(), "rank")


@query
def filtered_postings(spark, sf_dir):
    docs = collection(spark, sf_dir, with_vectors=False)
    index = _stored_index(spark, sf_dir)
    hits = index.search_filtered(match.any_of(*TOP_WORDS), docs, 20, {"tag": "hq", "labeled": True})
    return hits.select("id", _score(), "rank")


@query
def phrase_postings(spark, sf_dir):
    condition = match.phrase("the", "of") & match.prefix("estio")
    scored = _stored_index(spark, sf_dir).score(condition)
    return scored.select("id", _score())


@query
def prefix_postings(spark, sf_dir):
    """A prefix answered by the dictionary and the directories of its words."""
    return _stored_index(spark, sf_dir).score(match.prefix("estio")).select("id", _score())


@query
def near_postings(spark, sf_dir):
    """Places met from the rarer word on; the other word's postings are cut where they are read."""
    return _stored_index(spark, sf_dir).score(match.near("esat", "the", distance=3)).select("id", _score())


@query
def fulltext_early(spark, sf_dir):
    """The k best without the postings that cannot matter."""
    hits = _stored_index(spark, sf_dir).search_top(match.any_of(*TOP_WORDS), 10)
    return hits.select("id", _score(), "rank")


def _labelled(spark, sf_dir, condition=None):
    labels = load(spark, sf_dir, "labels")
    labels = labels.where(condition) if condition is not None else labels
    return labels.select(F.col("doc_id").cast("string").alias("id"))


def _revised(spark, sf_dir):
    """The labelled documents with a changed text."""
    docs = texts(spark, sf_dir).join(_labelled(spark, sf_dir), "id", "left_semi")
    return docs.select("id", F.concat("content", F.lit(" revised edition "), "lang").alias("content"), "lang")


@query
def postings_incremental(spark, sf_dir):
    toxic = _labelled(spark, sf_dir, F.col("toxic") == 1)
    changed = _revised(spark, sf_dir).join(toxic, "id", "left_anti")
    index = _stored_index(spark, sf_dir).append(changed, toxic)
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


# -- filters


def _filtering(name, filters):
    def run(spark, sf_dir):
        return collection(spark, sf_dir, with_vectors=False).where(filter_column(filters)).select("id")

    return query(run, name)


_filtering("filter_tag", {"tag": "fr"})
_filtering("filter_tags_all", {"tags": ["en", "hq"]})
_filtering("filter_meta_string", {"lang": "de"})
_filtering("filter_meta_bool", {"labeled": True})
_filtering("filter_meta_object", {"stats": {"quality": 1}})
_filtering("filter_meta_nested", {"stats.quality": 0})
_filtering("filter_combined", {"tag": "en", "source": "src7", "labeled": False})


@query
def filter_meta_number(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    return events.where(filter_column({"k": 42}, metadata="props")).select("event_id")


def _own_filter():
    """A filter per document, with three conditions; copies share theirs."""
    return F.to_json(F.struct(F.col("lang").alias("tag"), "source", "n_chars", F.struct(F.col("quality")).alias("stats")), {"ignoreNullFields": "false"})


def _filtered_by(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return docs.select(F.col("doc_id").cast("string").alias("filter_no"), _own_filter().alias("filters"))


@query
def filter_many(spark, sf_dir):
    """As many filters as there are labelled documents, in one pass."""
    return filter_join.passing(collection(spark, sf_dir, with_vectors=False), _filtered_by(spark, sf_dir))


# -- reading


@query
def get_documents(spark, sf_dir):
    found = listing.get_documents(collection(spark, sf_dir), _labelled(spark, sf_dir))
    return found.select("id", F.length("content").alias("n_chars"), "is_embedded", tags_to_csv("tags").alias("tags"))


@query
def list_page(spark, sf_dir):
    page = listing.list_page(collection(spark, sf_dir), limit=100, offset=50)
    return page.select("id", _seconds("created_at"), tags_to_csv("tags").alias("tags"), "is_embedded")


@query
def list_page_deep(spark, sf_dir):
    """A page far down, found by counting ranges of times."""
    page = listing.list_page(collection(spark, sf_dir), limit=40, offset=150, most=16)
    return page.select("id", _seconds("created_at"), tags_to_csv("tags").alias("tags"), "is_embedded")


@query
def project_minimal(spark, sf_dir):
    minimal = listing.project(collection(spark, sf_dir))
    return minimal.select("id", _seconds("created_at"), _seconds("updated_at"), "is_embedded")


@query
def project_none(spark, sf_dir):
    return listing.project(collection(spark, sf_dir), "none")


@query
def project_full(spark, sf_dir):
    full = listing.project(collection(spark, sf_dir), "full")
    return full.select("id", F.md5("content").alias("content"), "metadata", tags_to_csv("tags").alias("tags"), *_vector_summary())


@query
def pending_embeddings(spark, sf_dir):
    return listing.pending(collection(spark, sf_dir), 100).select("id", _seconds("created_at"))


@query
def collection_stats(spark, sf_dir):
    docs = collection(spark, sf_dir).withColumn("db", F.get("tags", F.lit(1)))
    stats = listing.collection_stats(docs, "db")
    return stats.select("db", "document_count", "embedded_count", _seconds("created_at"), _seconds("last_updated"))


# -- changes


def _batch(spark, sf_dir):
    """Labelled documents with new text, and passages as new documents."""
    changed = _revised(spark, sf_dir).select("id", "content", F.array("lang", F.lit("revised")).alias("tags"))
    added = load(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id")).alias("id"), F.col("text").alias("content"), F.array(F.lit("new")).alias("tags")
    )
    return changed.unionByName(added)


def _changed(docs):
    return docs.select(
        "id", F.md5("content").alias("content"), tags_to_csv("tags").alias("tags"),
        _seconds("created_at"), _seconds("updated_at"), "is_embedded",
    )


@query
def upsert_documents(spark, sf_dir):
    return _changed(mutate.upsert(collection(spark, sf_dir), _batch(spark, sf_dir), AS_OF))


@query
def upsert_unembeds(spark, sf_dir):
    docs = collection(spark, sf_dir)
    after = mutate.upsert(docs, _batch(spark, sf_dir), AS_OF)
    before = docs.where("is_embedded").select("id")
    return after.where(~F.col("is_embedded")).join(before, "id", "left_semi").select("id", F.col("vector").isNull().alias("cleared"))


def _doomed(spark, sf_dir):
    """Ids to delete: toxic documents, and passages that were never stored."""
    toxic = _labelled(spark, sf_dir, F.col("toxic") == 1)
    return toxic.unionByName(load(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("id")))


@query
def delete_documents(spark, sf_dir):
    return mutate.delete(collection(spark, sf_dir), _doomed(spark, sf_dir)).select("id")


@query
def delete_not_found(spark, sf_dir):
    return mutate.not_found(texts(spark, sf_dir), _doomed(spark, sf_dir))


@query
def update_vectors(spark, sf_dir):
    docs = mutate.update_vectors(collection(spark, sf_dir, with_vectors=False), vectors(spark, sf_dir), AS_OF)
    return docs.select("id", "is_embedded", _seconds("updated_at"), *_vector_summary())


@query
def assign_ids(spark, sf_dir):
    """Passages have no id of their own in this batch and get random ones."""
    batch = load(spark, sf_dir, "conversations").select(F.lit("").alias("id"), F.col("text").alias("content"))
    ids = mutate.with_ids(batch)
    return ids.agg(
        F.count("*").alias("n"), F.count_distinct("id").alias("n_distinct"), F.count_if(F.length("id") == 36).alias("n_uuid")
    )


@query
def upsert_missing_ids(spark, sf_dir):
    """A batch of turns without ids, all different: none may be lost."""
    turns = load(spark, sf_dir, "conversations")
    batch = turns.select(F.when(F.col("turn") % 2 == 0, "").alias("id"), F.concat_ws("/", "conv_id", "turn", "text").alias("content"))
    stored = Collection(spark, shared_dir(spark, "store"), "main", "turns", buckets=4)
    stored.upsert(batch, AS_OF)
    return stored.read().agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_distinct("content").alias("n_texts"))


# -- ingest


def _json_lines(spark, sf_dir):
    """Ingest requests as JSON text: toxic documents arrive without content,
    those of one source are cut off in the middle."""
    docs = collection(spark, sf_dir, with_vectors=False)
    content = F.when(F.array_contains("tags", "toxic"), F.lit("")).otherwise(F.col("content"))
    line = F.to_json(F.struct("id", content.alias("content"), F.struct(F.lit(True).alias("test")).alias("metadata"), "tags"))
    cut = F.when(F.array_contains("tags", "src7"), F.expr("left(line, length(line) - 2)")).otherwise(F.col("line"))
    path = shared_dir(spark, "ingest")
    docs.select("tags", line.alias("line")).select(cut.alias("value")).write.text(path)
    return path


@query
def ingest_valid(spark, sf_dir):
    records = ingest.read_json(spark, _json_lines(spark, sf_dir))
    docs = ingest.to_documents(records, as_of=AS_OF)
    return docs.select("id", F.md5("content").alias("content"), "metadata", tags_to_csv("tags").alias("tags"), "is_embedded")


@query
def ingest_rejected(spark, sf_dir):
    records = ingest.read_json(spark, _json_lines(spark, sf_dir))
    return ingest.rejected(records).groupBy("reason").agg(F.count("*").alias("n"))


@query
def ingest_wrong_kinds(spark, sf_dir):
    """Requests whose fields are of a kind that a request cannot have."""
    fields = [
        F.concat(F.lit('{"id":"a","content":'), F.col("doc_id"), F.lit("}")),
        F.concat(F.lit('{"content":"x","tags":['), F.col("doc_id"), F.lit("]}")),
        F.concat(F.lit('{"content":"x","metadata":'), F.col("doc_id"), F.lit("}")),
        F.concat(F.lit('{"content":"x","tags":["a",null],"metadata":{"n":'), F.col("doc_id"), F.lit("}}")),
        F.concat(F.lit('["'), F.col("doc_id"), F.lit('"]')),
    ]
    path = shared_dir(spark, "ingest")
    docs = load(spark, sf_dir, "documents")
    docs.select(F.element_at(F.array(*fields), (F.col("doc_id") % 5 + 1).cast("int")).alias("value")).write.text(path)
    records = ingest.read_json(spark, path)
    good = ingest.accepted(records).agg(F.lit("stored").alias("reason"), F.count("*").alias("n"))
    return good.unionByName(ingest.rejected(records).groupBy("reason").agg(F.count("*").alias("n")))


@query
def ingest_embed_sync(spark, sf_dir):
    docs = ingest.to_documents(texts(spark, sf_dir), LETTERS, "sync", AS_OF)
    return docs.select("id", "is_embedded", *_vector_summary())


@query
def ingest_embed_async(spark, sf_dir):
    docs = ingest.to_documents(texts(spark, sf_dir), embed.StubEmbedder(DIM), "async", AS_OF)
    return docs.select("id", "is_embedded", F.col("vector").isNull().alias("cleared"))


def _tags_round_trip(spark, sf_dir):
    docs = collection(spark, sf_dir, with_vectors=False).select("id", tags_to_csv("tags").alias("csv"))
    back = docs.withColumn("tags", tags_from_csv("csv"))
    return back.select("id", "csv", F.size("tags").alias("n_tags"), F.element_at("tags", -1).alias("last_tag"))


query(_tags_round_trip, "tags_from_csv")


@query
def parsed_times(spark, sf_dir):
    """Times written as text: with Z, with an offset and a fraction, and three that are no times."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    forms = [F.concat(ts, F.lit("Z")), F.concat(ts, F.lit(".250+02:00")), ts, F.concat(F.lit("2024-13-"), F.date_format("ts", "dd'T'HH:mm:ss'Z'")), F.lit("soon")]
    texts_of = load(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int")).alias("text"))
    return texts_of.select("event_id", F.unix_millis(parse_time("text")).alias("millis"))


# -- embedding


@query
def embed_stub(spark, sf_dir):
    docs = embed.embed_column(texts(spark, sf_dir), embed.StubEmbedder())
    return docs.select("id", *_vector_summary())


def _letter_counts(contents):
    return [[float(len(c)), float(c.count("a")), float(c.count("e"))] for c in contents]


def _letters(contents):
    """A vector that depends on the text and that SQL can compute, too."""
    return [[float(c.count(chr(97 + i % 26)) * (1 + i // 26)) for i in range(DIM)] for c in contents]


LETTERS = embed.BatchEmbedder(_letters, DIM)


def _fussy(contents):
    """Fails for texts that begin with an E."""
    if any(c.startswith("E") for c in contents):
        raise ValueError("begins with E")
    return _letters(contents)


@query
def embed_failures(spark, sf_dir):
    """A text that cannot be embedded does not spoil its batch."""
    docs = embed.embed_column(texts(spark, sf_dir), embed.BatchEmbedder(_fussy, DIM, "null"), error="error")
    return docs.select("id", F.col("vector").isNotNull().alias("done"), "error")


@query
def embed_custom(spark, sf_dir):
    docs = embed.embed_column(texts(spark, sf_dir), embed.BatchEmbedder(_letter_counts, 3))
    return docs.select("id", *(F.get("vector", F.lit(i)).cast("double").alias(f"v{i}") for i in range(3)))


@query
def embedding_backfill(spark, sf_dir):
    docs = collection(spark, sf_dir).withColumns({"db": F.lit("main"), "table": F.get("tags", F.lit(0))})
    done = embed.backfill_cycle(docs, embed.StubEmbedder(DIM), n=embed.CYCLE_SIZE)
    return done.select("db", "table", "id", F.size("vector").alias("dim"))


@query
def backfill_all(spark, sf_dir):
    """Without a rate, one cycle does the whole queue."""
    docs = collection(spark, sf_dir).withColumns({"db": F.lit("main"), "table": F.get("tags", F.lit(0))})
    return embed.backfill_cycle(docs, LETTERS).select("db", "table", "id", *_vector_summary())


@query
def backfill_with_failures(spark, sf_dir):
    """Five cycles at a rate: failing documents are given up after two tries
    and do not keep those behind them waiting."""
    base = shared_dir(spark, "store")
    stored = Collection(spark, base, "main", "docs", buckets=4)
    stored.upsert(collection(spark, sf_dir).drop("updated_at", "is_embedded"), AS_OF)
    errors = shared_dir(spark, "errors")
    for _ in range(5):
        run_backfill([stored], embed.BatchEmbedder(_fussy, DIM, "null"), n=20, as_of=AS_OF, errors=errors, max_tries=2)
    failed = read_failures(spark, errors).select("id", "tries", "error")
    return stored.read().select("id", "is_embedded").join(failed, "id", "left")


@query
def embedding_payloads(spark, sf_dir):
    """Stored answers in the three shapes, and some that are cut short."""
    shape = F.col("label") % 5
    plain = F.to_json("vector")
    raw = (
        F.when(shape == 0, plain)
        .when(shape == 1, F.concat(F.lit('{"embedding":'), plain, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('[{"index":0,"embedding":['), plain, F.lit("]}]")))
        .when(shape == 3, F.to_json(F.slice("vector", 1, 3)))
        .otherwise(F.concat(F.lit('{"embedding":'), plain))
    )
    stored = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector")).withColumn("raw", raw)
    parsed = stored.withColumn("parsed", parse_payload("raw", DIM)).select("vec_id", "parsed.*")
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    kind = F.when(F.col("error").startswith("dimension"), F.col("error")).when(F.col("error").isNotNull(), "unreadable")
    return parsed.select("vec_id", F.size("vector").alias("dim"), F.round(total, 4).alias("total"), kind.alias("error"))


# -- vectors


def _against_query(name, metric):
    def run(spark, sf_dir):
        fixed = F.array(*(F.lit(x).cast("float") for x in QUERY_VECTOR))
        docs = vectors(spark, sf_dir)
        return docs.select("id", F.round(similarity(metric, "vector", fixed), 6).alias("score"))

    return query(run, name)


_against_query("vec_cosine", "cosine")
_against_query("vec_euclidean", "euclidean")
_against_query("vec_dot", "dot")


@query
def vector_topk(spark, sf_dir):
    docs = vectors(spark, sf_dir).withColumn("is_embedded", F.lit(True))
    hits = vector.search_vectors(docs, QUERY_VECTOR, 10, digits=6)
    return hits.select("id", _score(), "rank")


@query
def vector_topk_euclidean(spark, sf_dir):
    docs = vectors(spark, sf_dir).withColumn("is_embedded", F.lit(True))
    hits = vector.search_vectors(docs, QUERY_VECTOR, 10, "euclidean", digits=6)
    return hits.select("id", _score(), "rank")


@query
def vector_ranked(spark, sf_dir):
    """Without a limit, every vector gets its rank."""
    docs = vectors(spark, sf_dir).withColumn("is_embedded", F.lit(True))
    hits = vector.search_vectors(docs, QUERY_VECTOR, 0, "dot", digits=6)
    return hits.select("id", _score(), F.col("rank").cast("int").alias("rank"))


@query
def vector_filtered(spark, sf_dir):
    hits = vector.search_vectors(collection(spark, sf_dir), QUERY_VECTOR, 20, filters={"tag": "en", "labeled": True}, digits=6)
    return hits.select("id", _score(), "rank")


@query
def knn_join(spark, sf_dir):
    docs = vectors(spark, sf_dir)
    hits = vector.knn_join(docs.select(F.col("id").alias("query_id"), "vector"), docs, 5, digits=6)
    return hits.select("query_id", "id", _score(), "rank")


@query
def knn_pivots(spark, sf_dir):
    """The same neighbours through stored blocks with bounds."""
    docs = vectors(spark, sf_dir)
    index = VectorIndex.write(docs, shared_dir(spark, "vectors"))
    hits = index.knn_join(docs.select(F.col("id").alias("query_id"), "vector"), 5, digits=6)
    return hits.select("query_id", "id", _score(), "rank")


@query
def metric_fallback(spark, sf_dir):
    """An unknown metric means cosine."""
    docs = vectors(spark, sf_dir).withColumn("is_embedded", F.lit(True))
    return vector.search_vectors(docs, QUERY_VECTOR, 10, "manhattan", digits=6).select("id", _score(), "rank")


@query
def vector_text_query(spark, sf_dir):
    """Passages are embedded and each searched among the documents."""
    asked = embed.embed_column(_passages(spark, sf_dir), LETTERS, text="query")
    hits = vector.knn_join(asked, vectors(spark, sf_dir), 10, digits=6)
    return hits.select("query_id", "id", _score(), "rank")


@query
def vector_dim_report(spark, sf_dir):
    return vector.dimension_report(collection(spark, sf_dir), DIM)


@query
def vector_blob_roundtrip(spark, sf_dir):
    blobs = vectors(spark, sf_dir).select("id", vector_to_blob("vector").alias("blob"))
    back = blobs.select("id", F.length("blob").alias("n_bytes"), blob_to_vector("blob").alias("vector"))
    return back.select("id", "n_bytes", *_vector_summary())


# -- the search front


def _requests(spark, sf_dir):
    """One request per passage, in all kinds, with and without filters."""
    n = F.col("item_id")
    kinds = ["fulltext", "vector", "hybrid", "", "fuzzy"]
    kind = F.element_at(F.array(*(F.lit(k) for k in kinds)), (n % 5 + 1).cast("int"))
    return load(spark, sf_dir, "benchmark").select(
        n.cast("string").alias("query_id"),
        F.when(n % 7 == 3, "").otherwise(F.col("text")).alias("query"),
        kind.alias("type"),
        F.when(n % 2 == 0, 5).otherwise(0).alias("limit"),
        F.when(n % 3 == 0, F.lit('{"lang": "en"}')).alias("filters"),
    )


@query
def search_requests(spark, sf_dir):
    hits = search.search_requests(collection(spark, sf_dir), _requests(spark, sf_dir), LETTERS, digits=9)
    return hits.select("query_id", "type", "id", _score(), "rank")


@query
def requests_postings(spark, sf_dir):
    """The same requests, texts answered by the stored index."""
    docs = collection(spark, sf_dir)
    hits = search.search_requests(docs.drop("content"), _requests(spark, sf_dir), LETTERS, digits=9, index=_stored_index(spark, sf_dir))
    return hits.select("query_id", "type", "id", _score(), "rank")


@query
def search_match_kinds(spark, sf_dir):
    """Requests with any-of, exclusion, phrase and prefix conditions; those
    with broken filters are refused alone."""
    return _match_kinds(spark, sf_dir, collection(spark, sf_dir, with_vectors=False))


@query
def match_kinds_postings(spark, sf_dir):
    """Any-of, exclusion, phrases and prefixes evaluated on postings."""
    docs = collection(spark, sf_dir, with_vectors=False).drop("content")
    return _match_kinds(spark, sf_dir, docs, index=_stored_index(spark, sf_dir))


def _match_kinds(spark, sf_dir, docs, **options):
    n = F.col("item_id") % 6
    kinds = ['{"any": ["esat", "lich", "que"]}', '{"none": ["of"]}', '{"phrases": ["the of"]}', '{"prefixes": ["estio"]}', '{"any": ["que"], "none": ["de"]}', "{}"]
    requests = load(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.when(n == 0, "esat lich que").when(n == 4, "que").otherwise("the").alias("query"),
        F.lit("fulltext").alias("type"),
        F.lit(7).alias("limit"),
        F.when(n == 5, '{"tag": 3}').alias("filters"),
        F.element_at(F.array(*(F.lit(k) for k in kinds)), (n + 1).cast("int")).alias("match"),
    )
    hits = search.search_requests(docs, requests, LETTERS, digits=9, **options)
    refused = search.rejected_requests(requests).select("query_id", F.col("reason").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("rank"))
    return hits.select("query_id", "id", _score(), "rank").unionByName(refused)


@query
def search_many_filters(spark, sf_dir):
    """A request per labelled document, each with a filter of its own."""
    return _many_filters(spark, sf_dir, collection(spark, sf_dir, with_vectors=False))


@query
def many_filters_postings(spark, sf_dir):
    """As many filters over the candidates that the stored index names."""
    docs = collection(spark, sf_dir, with_vectors=False).drop("content")
    return _many_filters(spark, sf_dir, docs, index=_stored_index(spark, sf_dir))


def _many_filters(spark, sf_dir, docs, **options):
    asked = _filtered_by(spark, sf_dir).select(
        F.col("filter_no").alias("query_id"), F.lit("the of").alias("query"), F.lit("").alias("type"), F.lit(3).alias("limit"),
        "filters", F.lit('{"any": ["the"]}').alias("match"),
    )
    hits = search.search_requests(docs, asked, LETTERS, digits=9, **options)
    return hits.select("query_id", "id", _score(), "rank")


@query
def search_rejected(spark, sf_dir):
    return search.rejected_requests(_requests(spark, sf_dir)).select("query_id", "reason")


@query
def search_response(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    hits = search.search_requests(collection(spark, sf_dir), requests, LETTERS, digits=9)
    answers = search.responses(requests, hits)
    ids = F.array_join(F.transform("results", lambda r: r["id"]), ",")
    return answers.select("query_id", "type", F.col("total").cast("int").alias("total"), ids.alias("ids"))


@query
def hybrid_topk(spark, sf_dir):
    docs = collection(spark, sf_dir)
    hits = search.search_hybrid(docs, match.any_of(*TOP_WORDS), QUERY_VECTOR, 20, digits=6)
    return hits.select("id", "score", _score("text_score"), "rank")


# -- stored collections and streams


@query
def stored_collection(spark, sf_dir):
    """Store, change and delete through files, then read back."""
    stored = Collection(spark, shared_dir(spark, "store"), "main", "docs", buckets=8)
    docs = collection(spark, sf_dir)
    stored.upsert(docs.select("id", "content", "metadata", "tags", "vector", "created_at"), AS_OF)
    stored.upsert(_batch(spark, sf_dir), AS_OF)
    stored.delete(_doomed(spark, sf_dir))
    return _changed(stored.read())


@query
def database_list(spark, sf_dir):
    """Documents stored as one database per language, those without one too,
    and listed again."""
    base = shared_dir(spark, "store")
    lang = F.coalesce("lang", F.lit("none"))
    docs = collection(spark, sf_dir).drop("updated_at", "is_embedded").join(texts(spark, sf_dir).select("id", lang.alias("db")), "id")
    revised = _revised(spark, sf_dir).withColumn("db", lang)
    for name in sorted(r["db"] for r in load(spark, sf_dir, "documents").select(lang.alias("db")).distinct().collect()):
        Collection(spark, base, name, "docs", buckets=4).upsert(docs.where(F.col("db") == name).drop("db"), AS_OF)
        Collection(spark, base, name, "revised", buckets=2).upsert(revised.where(F.col("db") == name).select("id", "content"), AS_OF)
    emptied = Collection(spark, base, "gone", "docs", buckets=2)
    emptied.upsert(_revised(spark, sf_dir).select("id", "content"), AS_OF)
    emptied.delete(_labelled(spark, sf_dir))
    found = list_databases(spark, base)
    return found.select(
        "name", "document_count", "embedded_count", _seconds("created_at"), _seconds("last_updated"), (F.col("size_bytes") > 0).alias("stored")
    )


@query
def collection_get(spark, sf_dir):
    """Documents by id, from the files of their buckets only."""
    stored = Collection(spark, shared_dir(spark, "store"), "main", "docs", buckets=16)
    stored.upsert(texts(spark, sf_dir).select("id", "content"), AS_OF)
    return stored.get("7", "42", "199", "absent").select("id", F.md5("content").alias("content"))


@query
def index_refresh(spark, sf_dir):
    """A text index brought up to date with a stored collection."""
    stored = Collection(spark, shared_dir(spark, "store"), "main", "docs", buckets=8)
    stored.upsert(texts(spark, sf_dir).select("id", "content"), AS_OF)
    since = stored.version()
    index = postings.TextIndex.build(stored.read()).write(shared_dir(spark, "index"))
    stored.upsert(_revised(spark, sf_dir).select("id", "content"), AS_OF)
    stored.delete(_labelled(spark, sf_dir, F.col("toxic") == 1))
    fresh = stored.refresh_index(index, since, store=True).postings
    return fresh.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query
def storage_bytes(spark, sf_dir):
    stored = Collection(spark, shared_dir(spark, "store"), "main", "docs", buckets=8)
    stored.upsert(texts(spark, sf_dir).select("id", "content"), AS_OF)
    return stored.size_bytes()


FILE_DOCS = 20_000  # documents aimed at per file of requests


def _parts(spark, sf_dir, files):
    """How many files a file of requests is split into, so that none grows with the tables."""
    return max(1, -(-load(spark, sf_dir, "documents").count() // (files * FILE_DOCS)))


def _arrivals(spark, sf_dir, files):
    """Documents as files of JSON requests, read as a stream."""
    path, parts = shared_dir(spark, "arrivals"), _parts(spark, sf_dir, files)
    docs = collection(spark, sf_dir, with_vectors=False).select("id", "content", "tags")
    docs.repartition(files * parts, "id").write.json(path)
    return ingest.stream_json(spark, path, files_per_batch=2 * parts)


@query
def stream_upsert(spark, sf_dir):
    stored = Collection(spark, shared_dir(spark, "store"), "main", "docs", buckets=8)
    arrivals = _arrivals(spark, sf_dir, files=4)
    stream_upserts(arrivals, stored, shared_dir(spark, "progress"), as_of=AS_OF, once=True).awaitTermination()
    return _changed(stored.read())


@query
def stream_index(spark, sf_dir):
    """A text index that follows a stream: documents arrive in two batches,
    then revised ones, and each batch is one commit of both."""
    stored = Collection(spark, shared_dir(spark, "store"), "main", "docs", buckets=8, indexed=True)
    path, progress, parts = shared_dir(spark, "arrivals"), shared_dir(spark, "progress"), _parts(spark, sf_dir, 4)
    for arrivals in (texts(spark, sf_dir), _revised(spark, sf_dir)):
        with shuffles_removed(spark):
            arrivals.select("id", "content").repartition(4 * parts, "id").write.mode("append").json(path, compression="gzip")
        records = ingest.stream_json(spark, path, files_per_batch=2 * parts)
        stream_upserts(records, stored, progress, as_of=AS_OF, once=True, keep=1).awaitTermination()
    return stored.index().postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@query
def stream_last_wins(spark, sf_dir):
    """Two versions of every labelled document in one file: the later line stays."""
    parts = _parts(spark, sf_dir, 2)
    path = shared_dir(spark, "arrivals")
    docs = texts(spark, sf_dir).join(_labelled(spark, sf_dir), "id", "left_semi")
    versions = docs.select("id", F.explode(F.array(F.lit("zzz first "), F.lit("last "))).alias("v"), "content")
    lines = versions.select("id", "v", F.to_json(F.struct("id", F.concat("v", "content").alias("content"))).alias("value"))
    lines.repartition(2 * parts, "id").sortWithinPartitions("id", F.desc("v")).select("value").write.text(path)
    stored = Collection(spark, shared_dir(spark, "store"), "main", "docs", buckets=4)
    stream_upserts(ingest.stream_json(spark, path), stored, shared_dir(spark, "progress"), as_of=AS_OF, once=True).awaitTermination()
    return stored.read().select("id", F.md5("content").alias("content"))


def _drained(spark, sf_dir):
    """Documents arrive unembedded; every micro-batch drains the queue."""
    base = shared_dir(spark, "store")
    stored = Collection(spark, base, "main", "docs", buckets=8)
    stored.upsert(collection(spark, sf_dir).drop("updated_at", "is_embedded"), AS_OF)
    ticks = _arrivals(spark, sf_dir, files=2)
    stream_backfill(ticks, base, LETTERS, shared_dir(spark, "progress"), as_of=AS_OF, once=True).awaitTermination()
    return stored.read().select("id", "is_embedded", *_vector_summary())


query(_drained, "stream_backfill")


@query
def backfill_queue(spark, sf_dir):
    """The queue is drained, then labelled documents get new texts: they alone
    wait, and a collection that nothing touched has no queue."""
    base = shared_dir(spark, "store")
    stored, still = (Collection(spark, base, "main", name, buckets=16) for name in ("docs", "still"))
    for target in (stored, still):
        target.upsert(collection(spark, sf_dir).drop("updated_at", "is_embedded"), AS_OF)
    run_backfill([stored, still], LETTERS, as_of=AS_OF)
    stored.upsert(_revised(spark, sf_dir).select("id", "content"), AS_OF)
    queues = [q for q in (stored.queue(), still.queue()) if q is not None]
    return reduce(DataFrame.unionByName, queues).select("table", "id", F.md5("content").alias("content"))


@query
def backfill_tables(spark, sf_dir):
    """One capped cycle over two stored tables, split by language."""
    base = shared_dir(spark, "store")
    docs = collection(spark, sf_dir).drop("updated_at", "is_embedded")
    english = F.array_contains("tags", "en")
    stored = [Collection(spark, base, "main", name, buckets=4) for name in ("english", "other")]
    for target, rows in zip(stored, [docs.where(english), docs.where(~english)]):
        target.upsert(rows, AS_OF)
    run_backfill(stored, embed.StubEmbedder(DIM), n=embed.CYCLE_SIZE, as_of=AS_OF)
    return stored[0].documents().unionByName(stored[1].documents()).select("table", "id", "is_embedded")
