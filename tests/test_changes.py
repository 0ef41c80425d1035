"""Upsert, delete, vector updates, ingest, and stored collections."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import listing, mutate
from docloom.operators.embed import StubEmbedder
from docloom.operators.fulltext import score_text, search_text
from docloom.operators.match import term
from docloom.operators.postings import TextIndex
from docloom.schema import DOCUMENT_COLUMNS
from docloom.session import shared_dir
from docloom.sources import ingest
from docloom.sources.collection import Collection, list_databases, open_all

DAY1, DAY2 = "2025-01-01 00:00:00", "2025-01-02 00:00:00"
BATCH = "id string, content string, vector array<float>, tags array<string>, n int"


def when(day):
    return dt.datetime.fromisoformat(day)


@pytest.fixture(scope="module")
def current(spark):
    rows = [("a", "old a", [1.0, 2.0], ["x"], 1), ("b", "old b", None, None, 1), ("c", "old c", [], ["z"], 1)]
    return mutate.complete(spark.createDataFrame(rows, BATCH), DAY1)


def by_id(df):
    rows = df.collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: r for r in rows}


def test_complete(current):
    rows = by_id(current)
    assert current.columns == DOCUMENT_COLUMNS
    assert [rows[i]["is_embedded"] for i in "abc"] == [True, False, False]
    assert rows["c"]["vector"] is None and rows["b"]["tags"] == [] and rows["b"]["metadata"] == "null"


def test_upsert(spark, current):
    batch = spark.createDataFrame(
        [("a", "new a", None, ["y"], 1), ("d", "first d", [9.0], [], 1), ("d", "last d", [8.0], [], 2), ("b", "new b", [7.0], None, 1)], BATCH
    )
    rows = by_id(mutate.upsert(current, batch, DAY2, order="n"))
    assert {i: r["content"] for i, r in rows.items()} == {"a": "new a", "b": "new b", "c": "old c", "d": "last d"}
    assert rows["a"]["created_at"] == when(DAY1) and rows["a"]["updated_at"] == when(DAY2)
    assert rows["d"]["created_at"] == when(DAY2) and rows["c"]["updated_at"] == when(DAY1)
    assert not rows["a"]["is_embedded"] and rows["a"]["vector"] is None
    assert rows["b"]["is_embedded"] and rows["b"]["vector"] == [7.0]


def test_one_id_fills_a_batch(spark, current):
    """Half of a batch are versions of one document."""
    hot = spark.range(2000).select(F.lit("a").alias("id"), F.concat(F.lit("v"), "id").alias("content"), F.col("id").alias("n"))
    cold = spark.range(2000).select(F.concat(F.lit("x"), "id").alias("id"), F.lit("y").alias("content"), F.col("id").alias("n"))
    rows = by_id(mutate.upsert(current, hot.unionByName(cold), DAY2, order="n"))
    assert len(rows) == 2003 and rows["a"]["content"] == "v1999"


def test_upsert_keeps_given_date(spark, current):
    batch = spark.createDataFrame([("a", "x", when("2020-05-05")), ("n", "x", when("2020-05-05"))], "id string, content string, created_at timestamp")
    rows = by_id(mutate.upsert(current, batch, DAY2))
    assert rows["a"]["created_at"] == when(DAY1) and rows["n"]["created_at"] == when("2020-05-05")


def test_delete(spark, current):
    ids = spark.createDataFrame([("a",), ("a",), ("nope",)], "id string")
    assert set(by_id(mutate.delete(current, ids))) == {"b", "c"}
    assert [r["id"] for r in mutate.not_found(current, ids).collect()] == ["nope"]


def test_update_vectors(spark, current):
    new = spark.createDataFrame([("b", [5.0]), ("nope", [1.0])], "id string, vector array<float>")
    rows = by_id(mutate.update_vectors(current, new, DAY2))
    assert set(rows) == {"a", "b", "c"} and rows["b"]["vector"] == [5.0] and rows["b"]["is_embedded"]
    assert rows["b"]["updated_at"] == when(DAY2) and rows["a"]["updated_at"] == when(DAY1)
    assert rows["b"]["content"] == "old b" and not rows["c"]["is_embedded"]


def test_ids_are_given(spark):
    batch = spark.createDataFrame([("",), (None,), ("keep",)], "id string")
    ids = [r["id"] for r in mutate.with_ids(batch).collect()]
    assert len(set(ids)) == 3 and "keep" in ids and sorted(map(len, ids)) == [4, 36, 36]


LINES = [
    '{"id": "a", "content": "hello", "metadata": {"k": [1, "z"]}, "tags": ["t"]}',
    '{"content": "no id"}',
    '{"id": "b", "content": ""}',
    '{"id": "c"}',
    '{"id": "d", "content": "cut',
]


def test_ingest(spark):
    path = shared_dir(spark, "lines")
    spark.createDataFrame([(line,) for line in LINES], "value string").write.text(path)
    records = ingest.read_json(spark, path).cache()
    docs = {r["content"]: r for r in ingest.to_documents(records, StubEmbedder(3), as_of=DAY1).collect()}
    assert set(docs) == {"hello", "no id"} and docs["hello"]["is_embedded"] and len(docs["no id"]["id"]) == 36
    assert json.loads(docs["hello"]["metadata"]) == {"k": [1, "z"]} and docs["no id"]["metadata"] == "null"
    reasons = sorted(r["reason"] for r in ingest.rejected(records).collect())
    assert reasons == ["content is required", "content is required", "invalid request body"]
    for mode, embedded in {"sync": True, "embed": True, "": True, "async": False, "later": False}.items():
        rows = ingest.to_documents(records, StubEmbedder(3), mode, DAY1).collect()
        assert {r["is_embedded"] for r in rows} == {embedded}
    assert not any(r["is_embedded"] for r in ingest.to_documents(records, None, "sync", DAY1).collect())


def test_listing(current):
    dated = current.withColumn("created_at", F.timestamp_seconds(F.ascii("id")))
    assert [r["id"] for r in listing.list_page(dated, 2, 1).collect()] == ["b", "a"]
    assert [r["id"] for r in listing.pending(dated, 1).collect()] == ["b"]
    assert [r["id"] for r in listing.get_documents(dated, "a").collect()] == ["a"]
    assert {r["id"] for r in listing.get_documents(dated, ["a", "c", "q"]).collect()} == {"a", "c"}
    assert listing.project(dated).columns == ["id", "created_at", "updated_at", "is_embedded"]
    assert listing.project(dated, "none").columns == ["id"]
    assert listing.project(dated, "full").columns == DOCUMENT_COLUMNS
    assert listing.collection_stats(dated).first()[:2] == (3, 1)
    assert listing.collection_stats(dated.limit(0)).first()[:2] == (0, 0)


def test_databases(spark):
    rows = [("mydb", "users", "user1", "John Doe is a software engineer"), ("mydb", "products", "prod1", "Laptop computer with 16GB RAM"), ("analytics", "events", "event1", "User login event from mobile app")]
    base = shared_dir(spark, "dbs")
    stored = [Collection(spark, base, db, table, buckets=2) for db, table, _, _ in rows]
    for target, (_, _, i, text) in zip(stored, rows):
        target.upsert(spark.createDataFrame([(i, text)], "id string, content string"), DAY1)
    docs = stored[0].documents().unionByName(stored[1].documents()).unionByName(stored[2].documents())
    stats = {r["db"]: (r["document_count"], r["embedded_count"]) for r in listing.collection_stats(docs, "db").collect()}
    assert stats == {"mydb": (2, 0), "analytics": (1, 0)}
    listed = {r["name"]: (r["document_count"], r["size_bytes"] > 0) for r in list_databases(spark, base).collect()}
    assert listed == {"mydb": (2, True), "analytics": (1, True)}
    assert [(c.db, c.table) for c in open_all(spark, base)] == [("analytics", "events"), ("mydb", "products"), ("mydb", "users")]
    assert list_databases(spark, base + "-none").collect() == []
    assert stored[0].get("user1").first()["content"] == "John Doe is a software engineer"
    assert [r["id"] for r in search_text(stored[0].read(), term("engineer")).collect()] == ["user1"]


def test_deep_pages(spark):
    rng = random.Random(4)
    times = [None, *(when(DAY1) + dt.timedelta(microseconds=t) for t in (0, 1, 5, 10**6, 10**6 + 1, 10**11))]
    rows = [(f"{rng.choice('abé')}{n:03}", rng.choices(times, [2, 9, 1, 5, 1, 1, 3])[0]) for n in range(300)]
    docs = spark.createDataFrame(rows, "id string, created_at timestamp")
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] - when(DAY1)) // dt.timedelta(microseconds=1) if r[1] else 0, r[0].encode()))
    for limit, offset, most in [(10, 0, 5), (10, 100, 20), (25, 133, 1), (40, 285, 8), (5, 299, 2), (7, 400, 3), (300, 0, 10), (3, 60, 10_000)]:
        page = listing.list_page(docs, limit, offset, most=most)
        assert [(r["id"], r["created_at"]) for r in page.collect()] == ordered[offset : offset + limit], (limit, offset, most)
    last, seen = None, []
    while len(seen) < 300:
        page = (listing.list_after(docs, last["created_at"], last["id"], 90) if last else listing.list_page(docs, 90)).collect()
        seen += [(r["id"], r["created_at"]) for r in page]
        last = page[-1]
    assert seen == ordered
    assert listing.list_page(docs.limit(0), 5, 50, most=1).collect() == []
    plan = listing.list_page(docs, 10, 100, most=20)._jdf.queryExecution().toString()
    assert "limit=110" not in plan and "offset=100" not in plan


def test_listing_reads_commits_only(spark, current):
    base = shared_dir(spark, "dbs")
    stored = Collection(spark, base, "my db", "t", buckets=3)
    stored.upsert(current.select("id", "content", "vector", "tags"), DAY1)
    stored.update_vectors(spark.createDataFrame([("b", [1.0])], "id string, vector array<float>"), DAY2)
    stored.upsert(spark.createDataFrame([("new", "x")], "id string, content string"), DAY2)
    stored.vacuum()
    listed = list_databases(spark, base)
    assert "/data/" not in str(listed.inputFiles()) and len(listed.inputFiles()) == 1
    row = listed.first()
    assert (row["name"], row["document_count"], row["embedded_count"], row["created_at"], row["last_updated"]) == ("my db", 4, 2, when(DAY1), when(DAY2))
    assert row["size_bytes"] == stored.size_bytes().first()[0] > 0
    assert stored._versions() == [3] and by_id(stored.read())["new"]["content"] == "x"


def test_stored_collection(spark, current):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=3, files_per_bucket=2)
    assert stored.read().count() == 0 and stored.documents().columns[-3:] == ["bucket", "db", "table"]
    stored.upsert(current.select("id", "content", "vector", "tags"), DAY1, note="n1")
    assert by_id(stored.read().drop("bucket")) == by_id(current)
    assert stored.has_commit("n1") and not stored.has_commit("n2")

    def places():
        return stored._commit()[1]

    before = places()
    stored.update_vectors(spark.createDataFrame([("b", [1.0])], "id string, vector array<float>"), DAY2)
    assert sum(before[k] != v for k, v in places().items()) == 1  # one bucket rewritten
    assert by_id(stored.read())["b"]["vector"] == [1.0]
    stored.delete(spark.createDataFrame([("a",), ("b",), ("c",), ("nope",)], "id string"))
    assert stored.read().count() == 0 and places() == {}
    stored.upsert(spark.createDataFrame([("z", "back")], "id string, content string"), DAY2)
    assert [r["content"] for r in stored.get("z").collect()] == ["back"] and stored.get("a").collect() == []
    assert stored.size_bytes().first()[0] > 0
    again = Collection(spark, stored.path.removesuffix("/db/t"), "db", "t", buckets=99)
    assert again.buckets == 3 and again.get("z").count() == 1


def test_index_refresh(spark):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=4)
    words = [(f"d{n}", f"word{n} common") for n in range(12)]
    stored.upsert(spark.createDataFrame(words, "id string, content string"), DAY1)
    index, since = TextIndex.build(stored.read()).write(shared_dir(spark, "index")), stored.version()
    stored.upsert(spark.createDataFrame([("d1", "changed common"), ("new", "word3")], "id string, content string"), DAY2)
    stored.delete(spark.createDataFrame([("d5",), ("d6",)], "id string"))
    fresh = stored.refresh_index(index, since)
    for word in ("common", "word1", "word3", "word5", "changed"):
        expected = {(r["id"], round(r["score"], 9)) for r in score_text(stored.read(), term(word)).collect()}
        assert {(r["id"], round(r["score"], 9)) for r in fresh.score(term(word)).collect()} == expected
    stored.delete(stored.read().select("id"))
    assert stored.refresh_index(index, since).postings.count() == 0


def test_failed_change_leaves_collection(spark, current):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=3)
    stored.upsert(current.select("id", "content"), DAY1)
    broken = spark.createDataFrame([("a", "1"), ("q", "x")], "id string, content string").withColumn("content", F.expr("cast(cast(content as int) as string)"))
    with pytest.raises(Exception):
        stored.upsert(broken, DAY2)
    assert set(by_id(stored.read())) == {"a", "b", "c"}
    stored.upsert(spark.createDataFrame([("q", "fine")], "id string, content string"), DAY2)
    assert set(by_id(stored.read())) == {"a", "b", "c", "q"}


def test_lookup_prunes_buckets(spark, current):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=3)
    stored.upsert(current.select("id", "content"), DAY1)
    assert "PartitionFilters: [isnotnull(bucket" in stored.get("a")._jdf.queryExecution().toString()


def test_a_batch_that_changes_loses_no_row(spark):
    """Ids drawn anew in every pass over the batch."""
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=8)
    batch = spark.range(40).select(F.concat(F.lit("r"), (F.rand() * 1e9).cast("long").cast("string")).alias("id"), F.col("id").cast("string").alias("content"))
    stored.upsert(batch, DAY1)
    assert sorted(int(r["content"]) for r in stored.read().collect()) == list(range(40))


def test_documents_without_id_stay_apart(spark, current):
    batch = spark.createDataFrame([(None, "one"), ("", "two"), (None, "three"), ("", "two")], "id string, content string")
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2)
    stored.upsert(batch, DAY1)
    assert sorted(r["content"] for r in stored.read().collect()) == ["one", "three", "two", "two"]
    assert mutate.upsert(current, batch, DAY2).count() == 7


def test_duplicates_need_an_order(spark, current):
    same = spark.createDataFrame([("x", "twice"), ("x", "twice")], "id string, content string")
    assert by_id(mutate.upsert(current, same, DAY2))["x"]["content"] == "twice"
    with pytest.raises(Exception, match="no order to choose by"):
        mutate.upsert(current, same.union(spark.createDataFrame([("x", "other")], "id string, content string")), DAY2).collect()


def test_vacuum_keeps_what_is_read(spark):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2)
    for n in range(3):
        stored.upsert(spark.range(20).select(F.col("id").cast("string").alias("id"), F.lit(f"v{n}").alias("content")), DAY1)
    assert stored.vacuum() == [1, 2]
    assert {r["content"] for r in stored.read().collect()} == {"v2"} and stored.read().count() == 20


def test_wrong_kinds_are_rejected(spark):
    path = shared_dir(spark, "in")
    lines = ['{"content": 5}', '{"content": {"z": 1}}', '{"content": "a", "tags": [1, 2]}', '{"content": "a", "metadata": 7}', '{"id": 3, "content": "a"}', "[]", "{", '{"content": "fine", "id": null, "tags": null}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    records = ingest.read_json(spark, path)
    assert ingest.rejected(records).count() == 7 and [r["content"] for r in ingest.accepted(records).collect()] == ["fine"]


def test_buckets_follow_the_size(spark, monkeypatch):
    from docloom.sources import collection as module

    monkeypatch.setattr(module, "MIN_BUCKETS", 1)
    monkeypatch.setattr(module, "BUCKET_BYTES", 50)
    base = shared_dir(spark, "store")
    stored = Collection(spark, base, "db", "t")
    docs = spark.range(30).select(F.col("id").cast("string").alias("id"), F.lit("ten bytes.").alias("content"))
    stored.upsert(docs, DAY1)
    assert stored.buckets == 6 and Collection(spark, base, "db", "t").buckets == 6
    index = TextIndex.build(stored.read()).write(shared_dir(spark, "index"))
    since = stored.version()
    stored.rebucket(3)
    assert Collection(spark, base, "db", "t").buckets == 3 and stored.read().count() == 30
    assert [r["id"] for r in Collection(spark, base, "db", "t").get("7").collect()] == ["7"]
    stored.upsert(spark.createDataFrame([("7", "seven")], "id string, content string"), DAY2)
    fresh = stored.refresh_index(index, since)
    assert [r["id"] for r in fresh.search(term("seven")).collect()] == ["7"] and fresh.search(term("ten")).count() == 29
