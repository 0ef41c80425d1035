"""The stored text index: dictionary, early end, intersections, and the index that a collection keeps."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import postings
from docloom.operators.fulltext import score_text, search_text
from docloom.operators.match import Leaf, any_of, initial, near, phrase, prefix, term
from docloom.operators.postings import TextIndex
from docloom.session import shared_dir
from docloom.sources.collection import Collection
from docloom.streaming.jobs import store_batch

DAY = "2025-01-01 00:00:00"


def zipf_corpus(seed, n=1500):
    """Some words are in nearly every document, others in a few; many documents are alike."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 40))]
        words += ["the"] * rng.randrange(0, 4) + ["rare"] * (i % 97 == 0) * rng.randrange(1, 5) + ["prefixed", "prefab"][: i % 3]
        rng.shuffle(words)
        rows.append((f"d{i:05}", " ".join(words)))
    return rows + [(f"t{i:03}", "tie rare the") for i in range(40)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(zipf_corpus(1), "id string, content string")


@pytest.fixture(scope="module")
def index(spark, corpus):
    return TextIndex.build(corpus).write(shared_dir(spark, "index"), buckets=5, splits=2)


def hits(df):
    return [(r["rank"], r["id"], round(r["score"], 9)) for r in df.orderBy("rank").collect()]


EARLY = {
    "rare and common": (any_of("rare", "the"), 10),
    "ties over the limit": (any_of("tie", "rare"), 7),
    "only common": (any_of("the", "w1"), 5),
    "one word": (term("w3"), 12),
    "a word twice": (any_of("rare", "w2", "rare"), 20),
    "more than there are": (any_of("rare", "absent"), 500),
    "all absent": (any_of("absent", "nowhere"), 3),
    "many words": (any_of(*(f"w{i}" for i in range(1, 12)), "the", "rare"), 25),
}


@pytest.mark.parametrize("case", EARLY)
def test_early_end_gives_the_same_hits(corpus, index, case):
    condition, k = EARLY[case]
    assert hits(index.search_top(condition, k)) == hits(search_text(corpus, condition, k).select("id", "score", "rank"))


def test_early_end_without_lookup_by_id(corpus, index, monkeypatch):
    monkeypatch.setattr(postings, "LOOKUP", 0)
    for condition, k in EARLY.values():
        assert hits(index.search_top(condition, k)) == hits(index.search(condition, k))


@pytest.mark.parametrize("seed", range(4))
def test_early_end_on_random_words(index, seed, monkeypatch):
    rng = random.Random(seed)
    condition = any_of(*(f"w{int(rng.paretovariate(0.5))}" for _ in range(rng.randrange(1, 6))), rng.choice(["the", "rare", "tie"]))
    k = rng.choice([1, 3, 30])
    full = hits(index.search(condition, k))
    monkeypatch.setattr(postings, "EARLY_ROWS", 0)  # search takes the early way by itself
    assert hits(index.search(condition, k)) == full


def rows_read(df, metric="numOutputRows"):
    """Rows that the postings scans of a plan gave, or another sum of theirs."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("Scan") and "term" in node.output().toString():
            total += node.metrics().apply(metric).value()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def test_early_end_reads_fewer_rows(spark, monkeypatch):
    rows = [(f"d{i:05}", "the " + ("needle " * (1 + i % 5) if i % 400 == 0 else "") + "filler " * (i % 7)) for i in range(12000)]
    monkeypatch.setattr(postings, "PAGE_ROWS", 200)
    stored = TextIndex.build(spark.createDataFrame(rows, "id string, content string")).write(shared_dir(spark, "index"), buckets=3, splits=1)
    condition = any_of("the", "needle")
    full, early = stored.search(condition, 5), stored.search_top(condition, 5)
    assert hits(full) == hits(early)
    assert rows_read(early) < rows_read(full) / 2


def test_tiers_are_bounded(index):
    bounds, n_docs, mean = index._bounds({"the": 1, "rare": 2})
    assert all(a >= b for tiers in bounds.values() for (a, *_), (b, *_) in zip(tiers, tiers[1:]))
    best = {w: max((r["part"] for r in index._partial(index._tier_rows({w: 0}), any_of("the", "rare", "rare"), n_docs, bounds, mean).collect())) for w in bounds}
    assert all(best[w] <= bounds[w][0][0] * (1 + 1e-12) for w in bounds)


def test_needs_one_segment(spark, corpus, index):
    with pytest.raises(ValueError):
        TextIndex.build(corpus).search_top(term("the"), 3)
    with pytest.raises(ValueError):
        index.search_top(phrase("tie", "rare"), 3)


PLACES = {
    "phrase": phrase("tie", "rare"),
    "phrase of common words": phrase("the", "w1"),
    "phrase twice": phrase("w1", "w1"),
    "phrase prefix": Leaf("w1 pre", prefix=True),
    "prefix": prefix("pref"),
    "absent prefix": prefix("zzz") | term("tie"),
    "initial": initial("the"),
    "near": near("rare", "the", distance=2),
    "near phrase": near(phrase("tie", "rare"), "the"),
    "and": near("rare", "w1") & prefix("pre"),
    "or": phrase("w1", "w2") | phrase("the", "rare"),
    "not": phrase("w1", "the").but_not(prefix("prefa")),
}


@pytest.mark.parametrize("case", PLACES)
def test_intersections_equal_the_scan(corpus, index, case):
    expected = {(r["id"], round(r["score"], 9)) for r in score_text(corpus, PLACES[case]).collect()}
    assert {(r["id"], round(r["score"], 9)) for r in index.score(PLACES[case]).collect()} == expected and expected


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_common_word_is_cut_where_it_is_read(index):
    documents, _, _ = index._by_document(phrase("rare", "the"))
    joins = [line for line in plan_of(documents).split("\n") if "Join" in line]
    assert joins and not any("SortMergeJoin" in line for line in joins)


def test_prefix_opens_the_directories_of_its_words(spark):
    rows = [(f"d{i}", f"alpha{i} beta") for i in range(30)]
    stored = TextIndex.build(spark.createDataFrame(rows, "id string, content string")).write(shared_dir(spark, "index"), buckets=50)
    found = stored.lookup([Leaf("bet", prefix=True)])
    assert found.count() == 30 and rows_read(found, "numFiles") == 1
    assert stored.lookup([Leaf("gamma", prefix=True)]).count() == 0
    assert stored.cells.where("term = 'beta'").agg(F.sum("n")).first()[0] == 30


# -- the index that a collection keeps

RECORDS = "id string, content string, metadata string, tags array<string>"


def records(spark, *rows):
    return spark.createDataFrame([(i, text, None, None) for i, text in rows], RECORDS)


def words_of(index):
    return {(r["term"], r["id"], r["tf"]) for r in index.postings.collect()}


def same_as_new(stored):
    index, fresh = stored.index(), TextIndex.build(stored.read())
    assert words_of(index) == words_of(fresh)
    assert tuple(index.totals.first()) == tuple(fresh.totals.first())


def test_index_follows_all_changes(spark, monkeypatch):
    from docloom.sources import collection as module

    monkeypatch.setattr(module, "MAX_SEGMENTS", 3)
    base = shared_dir(spark, "store")
    stored = Collection(spark, base, "db", "t", buckets=3, indexed=True)
    with pytest.raises(ValueError):
        stored.index()
    stored.upsert(records(spark, *((f"d{i}", f"word{i} common") for i in range(9))).select("id", "content"), DAY)
    same_as_new(stored)
    for n in range(4):
        stored.upsert(records(spark, (f"d{n}", f"changed {n}"), (f"new{n}", "added common")).select("id", "content"), DAY)
        same_as_new(stored)
    assert stored._state().index_name != "index-1"  # segments were joined
    before = stored._state().segment
    stored.update_vectors(spark.createDataFrame([("d1", [1.0])], "id string, vector array<float>"), DAY)
    assert stored._state().segment == before
    stored.rebucket(2)
    same_as_new(stored)
    stored.delete(spark.createDataFrame([("d1",), ("d2",)], "id string"))
    again = Collection(spark, base, "db", "t")
    assert again.indexed
    same_as_new(again)
    again.vacuum()
    same_as_new(again)
    assert {r["id"] for r in again.index().score(term("changed")).collect()} == {"d0", "d3"}


def test_index_of_a_collection_that_had_none(spark):
    base = shared_dir(spark, "store")
    Collection(spark, base, "db", "t", buckets=2).upsert(records(spark, ("a", "one"), ("b", "two")).select("id", "content"), DAY)
    stored = Collection(spark, base, "db", "t", indexed=True)
    stored.delete(spark.createDataFrame([("a",)], "id string"))
    same_as_new(stored)


class Lost(Exception):
    pass


def test_failure_between_index_and_commit(spark, monkeypatch):
    """Until the commit, neither documents nor index change; the batch that is delivered again changes both."""
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2, indexed=True)
    store_batch(records(spark, ("a", "old words"), ("b", "other words")), stored, "stream#0", as_of=DAY)
    second = records(spark, ("a", "new words"), ("c", "more words"))
    write = Collection._write_commit

    def fail(self, state):
        raise Lost

    monkeypatch.setattr(Collection, "_write_commit", fail)
    for _ in range(2):
        with pytest.raises(Lost):
            store_batch(second, stored, "stream#1", as_of=DAY)
    monkeypatch.setattr(Collection, "_write_commit", write)
    assert {r["id"]: r["content"] for r in stored.read().collect()} == {"a": "old words", "b": "other words"}
    same_as_new(stored)
    assert not stored.has_commit("stream#1")

    other = records(spark, ("z", "another change"))  # takes the number of the segment that never counted
    stored.upsert(other.select("id", "content"), DAY)
    same_as_new(stored)
    for _ in range(2):  # delivered again, and once more
        store_batch(second, stored, "stream#1", as_of=DAY)
        assert {r["id"]: r["content"] for r in stored.read().collect()} == {"a": "new words", "b": "other words", "c": "more words", "z": "another change"}
        same_as_new(stored)
    version = stored.version()
    store_batch(records(spark, ("a", "late")), stored, "stream#0", as_of=DAY)  # an old batch
    assert stored.version() == version


def test_failure_before_the_index(spark, monkeypatch):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2, indexed=True)
    first = records(spark, ("a", "old words"))
    publish = Collection._publish_index

    def fail(self, *args):
        raise Lost

    monkeypatch.setattr(Collection, "_publish_index", fail)
    with pytest.raises(Lost):
        store_batch(first, stored, "stream#0", as_of=DAY)
    assert stored.version() == 0 and stored.read().count() == 0
    monkeypatch.setattr(Collection, "_publish_index", publish)
    store_batch(first, stored, "stream#0", as_of=DAY)
    same_as_new(stored)


def test_notes_stay_few(spark):
    stored = Collection(spark, shared_dir(spark, "store"), "db", "t", buckets=2)
    for n in range(4):
        store_batch(records(spark, ("a", f"text {n}")), stored, f"one#{n}", as_of=DAY)
    store_batch(records(spark, ("b", "text")), stored, "two#7", as_of=DAY)
    assert stored._state().notes == {"one": 3, "two": 7}
    assert stored.has_commit("one#2") and stored.has_commit("two#7") and not stored.has_commit("two#8") and not stored.has_commit("three#0")
