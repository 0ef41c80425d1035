"""Work of one task, and rows shuffled, where tables grow."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm.line_dedup import deduplicate_lines
from docloom.operators import mutate, postings
from docloom.operators.fulltext import term_weight
from docloom.operators.postings import TextIndex
from docloom.plans import queries
from docloom.session import shared_dir, shuffles_removed
from docloom.sources import collection, ingest
from docloom.sources.collection import Collection
from docloom.streaming.jobs import store_batch


def files(spark, path, glob="*.parquet"):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return [r["path"] for r in found.select("path").collect()]


def test_a_write_has_as_many_files_as_its_size_asks_for(spark, monkeypatch):
    monkeypatch.setattr(collection, "FILE_BYTES", 1000)
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2)
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("content"))
    stored.upsert(rows, "2024-01-01")
    assert len(files(spark, f"{stored.path}/data/version=1")) > 10
    stored.upsert(rows.where("id < 100").withColumn("content", F.lit("new")), "2024-01-02")
    found = stored.read().select("id", "content")
    assert found.count() == 400 and found.where("content = 'new'").count() == 100 == found.where("content = 'new'").distinct().count()


def test_rows_of_one_id_are_still_chosen_from(spark):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2)
    rows = spark.createDataFrame([("a", "first", 1), ("a", "last", 2), ("b", "only", 1)], "id string, content string, n int")
    stored.upsert(rows, "2024-01-01", order="n")
    assert {(r["id"], r["content"]) for r in stored.read().collect()} == {("a", "last"), ("b", "only")}


def test_a_segment_lists_only_what_it_replaces(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, content string")
    path = shared_dir(spark, "index")
    index = TextIndex.build(make([("a", "x y"), ("b", "x")])).write(path)
    index = index.append(make([("b", "y"), ("c", "x z")]), make([("gone", "")]).select("id"))
    assert [r["id"] for r in spark.read.parquet(f"{path}/gone/segment=1").collect()] == ["b"]
    assert {(r["term"], r["id"]) for r in index.postings.collect()} == {("x", "a"), ("y", "a"), ("y", "b"), ("x", "c"), ("z", "c")}
    assert "BroadcastHashJoin" in index.postings._jdf.queryExecution().executedPlan().toString()


def test_files_of_requests_follow_the_number_of_documents(spark, tmp_path, monkeypatch):
    spark.range(100).select(F.col("id").alias("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries._parts(spark, str(tmp_path), 2) == 1
    monkeypatch.setattr(queries, "FILE_DOCS", 10)
    assert queries._parts(spark, str(tmp_path), 2) == 5


def test_line_dedup_has_one_plan_at_every_size(spark):
    lines = "one two three\nfour five six\n"
    docs = spark.createDataFrame([(1, lines + "a"), (2, "b\n" + lines)], "doc_id long, text string")
    out = deduplicate_lines(docs)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: 2}


def test_postings_reach_the_files_of_an_index_in_their_order(spark, monkeypatch):
    """The sort of a file then merges a run per block of documents."""
    seen, place = [], postings._place

    def spied(rows, path, segment, buckets, splits, mean_length, mode):
        tier = F.floor(term_weight(F.col("tf"), F.col("length"), F.lit(mean_length)) * postings.TIERS).alias("tier")
        seen.append([(r["term"], -r["tier"], r["id"]) for r in rows.select("term", "id", tier).collect()])
        place(rows, path, segment, buckets, splits, mean_length, mode)

    monkeypatch.setattr(postings, "_place", spied)
    make = lambda rows: spark.createDataFrame(rows, "id string, content string").coalesce(1)
    docs = [("d9", "z é a a a"), ("d1", "a z"), ("d5", ""), ("d30", "a " * 9 + "b"), ("d4", None), ("d2", "b a 中 z"), ("d7", "a z")]
    index = TextIndex.build(make(docs)).write(shared_dir(spark, "index"), buckets=2)
    index = index.append(make([("d8", "z a"), ("d1", "z a a a a a"), ("d6", "b")]))
    assert [len(rows) for rows in seen] == [13, 5] and all(rows == sorted(rows, key=lambda r: (r[0].encode(), *r[1:])) for rows in seen)
    found = {(r["term"], r["id"], r["tf"], r["length"], *r["positions"]) for r in index.postings.collect()}
    assert {f for f in found if f[1] in ("d9", "d1")} == {
        ("z", "d9", 1, 5, 0), ("e", "d9", 1, 5, 1), ("a", "d9", 3, 5, 2, 3, 4), ("z", "d1", 1, 6, 0), ("a", "d1", 5, 6, 1, 2, 3, 4, 5)
    }


def test_the_order_of_a_block_changes_no_posting():
    ids, lists = pa.array(["b", "a", None, "c"]), pa.array([["y", "x", "y"], [], ["x"], ["z", "x", "x", "x"]])
    key = lambda r: (r["term"], str(r["id"]))
    plain, ordered = (postings._group_tokens(ids, lists, mean).to_pylist() for mean in (None, 2.0))
    assert sorted(plain, key=key) == sorted(ordered, key=key)
    assert postings._group_tokens(pa.array(["a"]), pa.array([[]], pa.list_(pa.string())), 1.0).num_rows == 0


def folders(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place) if f.isDirectory())


def test_a_stream_keeps_no_version_that_nobody_reads(spark):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2, indexed=True)
    batch = lambda n: spark.createDataFrame([(f"d{i}", f"word{n} w{i}") for i in range(n, n + 10)], "id string, content string")
    for n in range(4):
        store_batch(batch(n), stored, f"s#{n}", as_of="2024-01-01", keep=1)
    assert folders(spark, f"{stored.path}/data") == ["version=4"] and folders(spark, f"{stored.path}/commits") == ["version=4"]
    store_batch(batch(1), stored, "s#1", as_of="2024-01-01", keep=1)  # delivered again
    assert stored.version() == 4 and folders(spark, stored.path) == ["commits", "data", "index-1"]
    found = {(r["term"], r["id"]) for r in stored.index().postings.collect()}
    latest = {f"d{i}": min(i, 3) for i in range(13)}
    assert found == {(word, i) for i, n in latest.items() for word in (f"word{n}", f"w{i[1:]}")}
    store_batch(batch(4), stored, "s#4", as_of="2024-01-01")
    assert folders(spark, f"{stored.path}/data") == ["version=4", "version=5"]
    assert stored.vacuum() == [4] and stored.vacuum() == []


def test_buckets_that_stay_keep_their_old_version(spark):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=8)
    row = lambda i, text: spark.createDataFrame([(i, text)], "id string, content string")
    for n, i in enumerate("abca"):
        store_batch(row(i, str(n)), stored, f"s#{n}", as_of="2024-01-01", keep=1)
    places = {b: v for b, v in stored._commit()[1].items()}
    assert {r["id"]: r["content"] for r in stored.read().collect()} == {"a": "3", "b": "1", "c": "2"}
    assert folders(spark, f"{stored.path}/data") == sorted({f"version={v}" for v in places.values()})


def test_texts_stay_where_they_are_in_an_upsert(spark):
    make = lambda rows: mutate.complete(spark.createDataFrame(rows, "id string, content string, created_at timestamp"), "2024-01-01")
    day = lambda n: __import__("datetime").datetime(2023, 1, n)
    current, batch = make([("a", "x", day(1)), ("b", "y", day(2)), ("d", None, None)]), make([("b", "z", day(3)), ("c", "w", None), ("d", "v", day(4))])
    sent, joined = (mutate.upsert(current, batch, "2024-01-02", unique=True, few=few) for few in (True, False))
    assert sorted(map(str, sent.collect())) == sorted(map(str, joined.collect())) and sent.count() == 4
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_changed_texts_are_taken_by_id(spark, monkeypatch):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2)
    rows = lambda *pairs: spark.createDataFrame(pairs, "id string, content string")
    stored.upsert(rows(("a", "x"), ("b", "y"), ("c", None), ("e", "same")), "2024-01-01")
    stored.upsert(rows(("b", "z"), ("d", "w"), ("c", "v"), ("e", "same")), "2024-01-02")
    stored.delete(rows(("a", "")))
    now, before = stored._commit()[1], stored._commit(1)[1]
    for most in (2_000_000, 0):
        monkeypatch.setattr(collection, "BROADCAST_GONE", most)
        changed, gone = stored._text_changes(now, before)
        assert {(r["id"], r["content"]) for r in changed.collect()} == {("b", "z"), ("c", "v"), ("d", "w")}
        assert {r["id"] for r in gone.collect()} == {"a", "b", "c"}
    monkeypatch.undo()
    plan = stored._text_changes(now, before)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (id" in plan and "rightHint=(strategy=broadcast)" in plan


def test_ids_that_repeat_are_seen_without_texts(spark):
    rows = lambda *ids: spark.createDataFrame([(i, "x") for i in ids], "id string, content string")
    assert ingest.all_differ(rows("a", "b", None, None, "", "")) and not ingest.all_differ(rows("a", "b", "a"))
    assert ingest.to_documents(rows("a", "b"), unique=True).count() == 2 == ingest.to_documents(rows("a", "b", "a")).count()


def test_shuffle_files_go_with_their_query(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(str(manager.getAllFiles().apply(i).getName()).startswith("shuffle_") for i in range(manager.getAllFiles().size()))
    before = shuffled()
    with shuffles_removed(spark):
        spark.range(1000).repartition(7, "id").write.parquet(shared_dir(spark, "rows"))
    until = time.time() + 20
    while shuffled() > before and time.time() < until:
        time.sleep(0.2)
    assert shuffled() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
