"""Embedders, backfill, request tables, hybrid search, streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import embed, mutate, search
from docloom.operators.embed import BatchEmbedder, StubEmbedder, backfill_cycle, embed_column
from docloom.operators.match import any_of
from docloom.session import shared_dir
from docloom.sources import ingest
from docloom.sources.collection import Collection
from docloom.streaming.jobs import read_failures, run_backfill, store_batch, stream_backfill, stream_upserts

DAY1 = "2025-01-01 00:00:00"


def counts(texts):
    if any("bad" in t for t in texts):
        raise RuntimeError("bad text")
    return np.array([[t.count("a"), t.count("b"), 1] for t in texts])


def test_embedders(spark):
    df = spark.createDataFrame([("aab",), ("b",)], "content string")
    rows = embed_column(df, BatchEmbedder(counts, 3)).collect()
    assert {r["content"]: r["vector"] for r in rows} == {"aab": [2.0, 1.0, 1.0], "b": [0.0, 1.0, 1.0]}
    stub = embed_column(df, StubEmbedder()).first()["vector"]
    assert len(stub) == embed.STUB_DIM and set(stub) == {np.float32(0.1).item()}


def test_embedder_failures(spark):
    df = spark.createDataFrame([("a",), ("bad",), ("b",)], "content string").coalesce(1)
    rows = {r["content"]: r for r in embed_column(df, BatchEmbedder(counts, 3, "null"), error="error").collect()}
    assert rows["a"]["vector"] == [1.0, 0.0, 1.0] and rows["bad"]["vector"] is None and rows["bad"]["error"] == "bad text"
    with pytest.raises(Exception, match="bad text"):
        embed_column(df, BatchEmbedder(counts, 3)).collect()
    rows = embed_column(df.where("content = 'a'"), BatchEmbedder(counts, 4, "null"), error="error").collect()
    assert rows[0]["error"] == "dimension is not 4"


def queue(spark, rows):
    df = spark.createDataFrame(rows, "db string, table string, id string, content string, n int, is_embedded boolean")
    return df.withColumn("created_at", F.timestamp_seconds("n"))


def test_backfill_order_and_failures(spark):
    rows = [("d1", "t1", f"i{n}", "bad" if n < 2 else "a", n, n == 3) for n in range(8)]
    rows += [("d1", "t0", "x", "a", 99, False), ("d0", "t", "y", "bad", 0, False)]
    done = backfill_cycle(queue(spark, rows), BatchEmbedder(counts, 3, "null"), n=4).collect()
    # of t1 the oldest four pending are i0 i1 i2 i4, two of which fail
    assert {(r["db"], r["table"], r["id"]) for r in done} == {("d1", "t0", "x"), ("d1", "t1", "i2"), ("d1", "t1", "i4")}
    done = backfill_cycle(queue(spark, rows), StubEmbedder(2), n=2).collect()
    assert [(r["db"], r["id"]) for r in done] == [("d0", "y"), ("d1", "x")]
    assert backfill_cycle(queue(spark, rows), StubEmbedder(2), n=None).count() == 9


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        ("1", "apple pie apple", [1.0, 0.0], ["en"], '{"y": 1}'), ("2", "apple tart", [0.6, 0.8], ["en"], '{"y": 2}'),
        ("3", "apple cake cake", None, ["fr"], '{"y": 1}'), ("4", "plum pie", [0.0, 1.0], ["fr"], '{"y": 2}'),
        ("5", "nothing here", [-1.0, 0.0], ["en"], None), ("6", "nothing there at all", [0.0, 0.0], ["en"], None),
    ]
    return mutate.complete(spark.createDataFrame(rows, "id string, content string, vector array<float>, tags array<string>, metadata string"), DAY1)


def test_hybrid(docs):
    hits = search.search_hybrid(docs, any_of("apple", "pie"), [0.6, 0.8], digits=6).orderBy("rank").collect()
    assert [(h["id"], h["score"]) for h in hits] == [("2", 1.0), ("4", 0.8), ("1", 0.6), ("3", None)]
    assert all(h["text_score"] < 0 for h in hits)


def towards_plum(texts):
    return [[0.6, 0.8] for _ in texts]


REQUESTS = [
    ("q1", "apple", "fulltext", 2, None), ("q2", "apple pie", "", 0, None), ("q3", "plum", "vector", 3, None),
    ("q4", "apple", "hybrid", -1, '{"tag": "en"}'), ("q5", "", "fulltext", 1, None), ("q6", "x", "exact", 1, None),
    ("q7", "zebra", "fulltext", 1, None), ("q8", "apple", None, 5, '{"y": 1}'), ("q9", None, "vector", 5, None),
    ("q10", "plum", "vector", 9, '{"tags": ["en"]}'), ("q11", "...", "fulltext", 9, None),
]


@pytest.mark.parametrize("layout", [{}, {"max_broadcast": 0, "cell_queries": 2, "cell_elements": 4}])
def test_requests(spark, docs, layout):
    requests = spark.createDataFrame(REQUESTS, "query_id string, query string, type string, limit int, filters string")
    hits = search.search_requests(docs, requests, BatchEmbedder(towards_plum, 2), digits=9, **layout)
    got = {}
    for h in hits.orderBy("query_id", "rank").collect():
        got.setdefault(h["query_id"], []).append(h["id"])
    assert {q: sorted(ids) for q, ids in got.items() if q in ("q1", "q8")} == {"q1": ["1", "2"], "q8": ["1", "3"]}
    assert {q: ids for q, ids in got.items() if q not in ("q1", "q8")} == {
        "q2": ["1"], "q3": ["2", "4", "1"], "q4": ["2", "1"], "q10": ["2", "1", "6", "5"]
    }
    reasons = {r["query_id"]: r["reason"] for r in search.rejected_requests(requests).collect()}
    assert reasons == {"q5": "query is required", "q6": "invalid search type: exact", "q9": "query is required"}
    answers = {r["query_id"]: r for r in search.responses(requests, hits).collect()}
    assert {q: r["total"] for q, r in answers.items()} == {"q1": 2, "q2": 1, "q3": 3, "q4": 2, "q7": 0, "q8": 2, "q10": 4, "q11": 0}
    assert [r["rank"] for r in answers["q3"]["results"]] == [1, 2, 3] and answers["q7"]["results"] == []


def test_many_filters_take_several_passes(spark, docs, monkeypatch):
    monkeypatch.setattr(search, "MATCHES_PER_PASS", 1)
    monkeypatch.setattr(search.path_groups, "__defaults__", (1,))  # metadata paths of a pass
    requests = spark.createDataFrame(REQUESTS, "query_id string, query string, type string, limit int, filters string")
    hits = search.search_requests(docs, requests, BatchEmbedder(towards_plum, 2))
    assert hits.groupBy("query_id").count().count() == 6


def test_no_requests(spark, docs):
    requests = spark.createDataFrame([], "query_id string, query string, type string, limit int, filters string")
    hits = search.search_requests(docs, requests, StubEmbedder(2))
    assert hits.columns == ["query_id", "type", "id", "score", "rank"] and hits.collect() == []


def arrive(spark, path, rows):
    frame = spark.createDataFrame(rows, "id string, content string, n int")
    frame.coalesce(1).write.mode("append").json(path)


def test_stream_upserts_and_backfill(spark):
    path, progress = shared_dir(spark, "in"), shared_dir(spark, "progress")
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2)

    def drain():
        records = ingest.stream_json(spark, path)
        stream_upserts(records, stored, progress, as_of=DAY1, once=True).awaitTermination()
        return {r["id"]: r["content"] for r in stored.read().collect()}

    arrive(spark, path, [("a", "one", 1), ("b", "", 1)])
    assert drain() == {"a": "one"}
    arrive(spark, path, [("a", "two", 1), ("c", "three", 1)])
    assert drain() == {"a": "two", "c": "three"}
    assert drain() == {"a": "two", "c": "three"}  # nothing new, nothing repeated
    assert stored.has_commit(f"{progress}#0") and stored.has_commit(f"{progress}#1")

    run_backfill([stored], StubEmbedder(2), n=1, as_of=DAY1)
    assert sorted(r["is_embedded"] for r in stored.read().collect()) == [False, True]
    ticks = ingest.stream_json(spark, path)
    stream_backfill(ticks, [stored], StubEmbedder(2), shared_dir(spark, "progress"), once=True).awaitTermination()
    assert all(r["is_embedded"] for r in stored.read().collect())
    run_backfill([stored], StubEmbedder(2))  # an empty queue is fine


def test_queue_opens_only_buckets_that_wait(spark, monkeypatch):
    base = shared_dir(spark, "store")
    stored, other, empty = (Collection(spark, base, "db", t, buckets=8) for t in ("t", "u", "v"))
    assert empty.queue() is None
    batch = spark.createDataFrame([(f"d{i}", f"text {i}") for i in range(40)], "id string, content string")
    stored.upsert(batch, DAY1)
    other.upsert(batch.limit(1), DAY1)
    assert stored.queue().count() == 40 and len(stored.queue().inputFiles()) == len(stored.read().inputFiles()) == 8
    run_backfill([stored, other, empty], StubEmbedder(2), as_of=DAY1)
    versions = [t.version() for t in (stored, other, empty)]
    assert stored.queue() is other.queue() is None and versions[2] == 0

    with monkeypatch.context() as patched:  # a cycle without news opens no document file and writes none
        patched.setattr(Collection, "_read", lambda *_: pytest.fail("documents were read"))
        run_backfill([stored, other, empty], StubEmbedder(2), as_of=DAY1)
    assert [t.version() for t in (stored, other, empty)] == versions

    stored.upsert(spark.createDataFrame([("d7", "new text"), ("d7x", "more")], "id string, content string").limit(1), DAY1)
    assert [r["id"] for r in stored.queue().collect()] == ["d7"] and len(stored.queue().inputFiles()) == 1
    stored.delete(spark.createDataFrame([("d7",)], "id string"))
    assert stored.queue() is None
    stored.upsert(batch.where("id = 'd3'"), DAY1)
    run_backfill([stored, other], StubEmbedder(2), as_of=DAY1)
    assert stored.queue() is None and stored.version() == versions[0] + 4 and other.version() == versions[1]
    assert stored.read().where("is_embedded").count() == 39

    failing = BatchEmbedder(lambda texts: [None for _ in texts], 2, "null")
    stored.upsert(batch.where("id = 'd4'"), DAY1)
    errors = shared_dir(spark, "errors")
    for _ in range(3):  # a document that is given up still waits, but is not tried again
        run_backfill([stored], failing, as_of=DAY1, errors=errors, max_tries=2)
    assert stored.queue().count() == 1 and [r["tries"] for r in read_failures(spark, errors).collect()] == [2]


def test_redelivered_batch_is_applied_once(spark):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2)
    batch = spark.createDataFrame([(None, "one"), ("a", "two")], "id string, content string")
    for _ in range(2):
        store_batch(batch, stored, "s#0", as_of=DAY1)
    assert sorted(r["content"] for r in stored.read().collect()) == ["one", "two"]
    store_batch(batch, stored, "s#1", as_of=DAY1)
    assert sorted(r["content"] for r in stored.read().collect()) == ["one", "one", "two"]


def test_order_within_a_batch(spark):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2)
    batch = spark.createDataFrame([("a", "last", 2), ("a", "first", 1)], "id string, content string, n int")
    store_batch(batch, stored, "s#0", order="n", as_of=DAY1)
    assert [r["content"] for r in stored.read().collect()] == ["last"]
