"""Tokenizer, match conditions, BM25, and the stored index, by brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions.text import query_tokens, tokens
from docloom.operators.fulltext import hydrate, match_text, score_text, search_text
from docloom.operators.match import Leaf, all_of, any_of, initial, near, phrase, prefix, term
from docloom.operators.postings import TextIndex
from docloom.operators.text_batch import search_text_batch
from docloom.session import shared_dir

SAMPLES = {
    "Hello, World_of 2024!": ["hello", "world", "of", "2024"],
    "Élan ÇA über naïve": ["elan", "ca", "uber", "naive"],
    "éa straße ộ": ["ea", "straße", "ộ"],
    "Привет МИР 東京": ["привет", "мир", "東京"],
    " .,;- ": [],
    "": [],
}


def test_tokens(spark):
    df = spark.createDataFrame([(t,) for t in SAMPLES], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", tokens("t").alias("k")).collect()} == SAMPLES


@pytest.mark.parametrize("text", SAMPLES)
def test_query_tokens_agree(text):
    assert query_tokens(text) == SAMPLES[text]


WORDS = ["the", "cat", "sat", "on", "mat", "catalog", "dog", "ran"]
_random = random.Random(7)
CORPUS = {f"d{i:02}": [_random.choice(WORDS[: 3 + i % 6]) for _ in range(_random.randrange(0, 30))] for i in range(60)}


def has(words, leaf):
    return [i for i in range(len(words)) if words[i : i + len(leaf)] == leaf]


def starts(words, leaf: Leaf):
    found = []
    for i in range(len(words) - len(leaf.words) + 1):
        run = words[i : i + len(leaf.words)]
        same = run[:-1] == leaf.words[:-1] and (run[-1].startswith(leaf.words[-1]) if leaf.prefix else run[-1] == leaf.words[-1])
        if same and (i == 0 or not leaf.initial):
            found.append(i)
    return found


def is_near(words, condition):
    options = [starts(words, p) for p in condition.parts]

    def pick(chosen, rest):
        if not rest:
            last = max(p for p in chosen)
            return all(last - (p + len(leaf.words)) <= condition.distance for p, leaf in zip(chosen, condition.parts))
        return any(pick([*chosen, p], rest[1:]) for p in rest[0])

    return pick([], options)


CASES = {
    "term": (term("Cat"), lambda w: "cat" in w),
    "all": (all_of("cat", "sat"), lambda w: "cat" in w and "sat" in w),
    "any": (any_of("dog", "ran"), lambda w: "dog" in w or "ran" in w),
    "not": (term("cat").but_not(term("sat")), lambda w: "cat" in w and "sat" not in w),
    "phrase": (phrase("the", "cat"), lambda w: bool(has(w, ["the", "cat"]))),
    "phrase3": (phrase("the cat sat"), lambda w: bool(has(w, ["the", "cat", "sat"]))),
    "prefix": (prefix("cat"), lambda w: any(t.startswith("cat") for t in w)),
    "phrase prefix": (Leaf("the cat", prefix=True), lambda w: bool(starts(w, Leaf("the cat", prefix=True)))),
    "initial": (initial("the"), lambda w: w[:1] == ["the"]),
    "near": (near("cat", "mat", distance=1), lambda w: is_near(w, near("cat", "mat", distance=1))),
    "near3": (near("cat", "mat", phrase("the", "sat"), distance=2), lambda w: is_near(w, near("cat", "mat", phrase("the", "sat"), distance=2))),
    "tree": ((term("dog") & any_of("cat", "mat")) | phrase("on", "mat"), lambda w: ("dog" in w and ("cat" in w or "mat" in w)) or bool(has(w, ["on", "mat"]))),
    "twice": (any_of("cat", "cat", "dog"), lambda w: "cat" in w or "dog" in w),
    "absent": (any_of("zebra", "dog"), lambda w: "dog" in w),
}


def bm25(words, condition):
    n_docs = len(CORPUS)
    mean_length = sum(map(len, CORPUS.values())) / n_docs
    total = 0.0
    for leaf in condition.leaves():
        df = sum(bool(starts(w, leaf)) for w in CORPUS.values())
        weight = math.log((n_docs - df + 0.5) / (df + 0.5))
        weight = weight if weight > 0 else 1e-6
        tf = len(starts(words, leaf))
        total += weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean_length))
    return -total


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, " ".join(w)) for i, w in CORPUS.items()], "id string, content string")


@pytest.fixture(scope="module")
def index(spark, corpus):
    return TextIndex.build(corpus).write(shared_dir(spark, "index"), buckets=4, splits=2)


@pytest.mark.parametrize("case", CASES)
def test_scan_and_index(corpus, index, case):
    condition, rule = CASES[case]
    expected = {i: round(bm25(w, condition), 9) for i, w in CORPUS.items() if rule(w)}
    assert expected
    assert {r["id"] for r in match_text(corpus, condition).collect()} == set(expected)
    for scored in (score_text(corpus, condition), index.score(condition)):
        assert {r["id"]: round(r["score"], 9) for r in scored.collect()} == expected


def test_top_and_hydrate(corpus, index):
    condition = any_of("dog", "mat")
    order = sorted((bm25(w, condition), i) for i, w in CORPUS.items() if "dog" in w or "mat" in w)
    ranks = [(i, n + 1) for n, (_, i) in enumerate(order)]
    for hits in (search_text(corpus, condition, 10), index.search(condition, 10)):
        assert [(r["id"], r["rank"]) for r in hits.orderBy("rank").collect()] == ranks[:10]
    for hits in (search_text(corpus, condition), index.search(condition), search_text(corpus, condition, -1)):  # no limit: all
        assert [(r["id"], r["rank"]) for r in hits.orderBy("rank").collect()] == ranks
    joined = hydrate(index.search(condition, 3), corpus)
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().toString()
    full = joined.collect()
    assert {r["id"]: r["content"] for r in full} == {i: " ".join(CORPUS[i]) for _, i in order[:3]}


def test_filters_do_not_change_scores(corpus):
    tagged = corpus.withColumns({"tags": F.array(F.when(F.col("id") < "d30", "low").otherwise("high")), "metadata": F.lit("null")})
    every = {r["id"]: r["score"] for r in score_text(tagged, term("dog")).collect()}
    low = {r["id"]: r["score"] for r in score_text(tagged, term("dog"), {"tag": "low"}).collect()}
    assert low == {i: s for i, s in every.items() if i < "d30"} and low


def test_index_update(spark, corpus, index):
    changed = spark.createDataFrame([("d01", "zebra dog"), ("new", "zebra"), ("d02", "")], "id string, content string")
    gone = spark.createDataFrame([("d03",), ("d04",)], "id string")
    after = index.update(changed, gone)
    current = corpus.join(changed.unionByName(gone.withColumn("content", F.lit(""))), "id", "left_anti").unionByName(changed)
    for condition in (any_of("zebra", "dog"), phrase("the", "cat"), near("cat", "sat")):
        expected = {(r["id"], round(r["score"], 9)) for r in score_text(current, condition).collect()}
        assert {(r["id"], round(r["score"], 9)) for r in after.score(condition).collect()} == expected
    stored = after.write(shared_dir(spark, "index"), buckets=4, splits=2)
    assert stored.postings.count() == after.postings.count()
    assert stored.score(term("zebra")).count() == 2


def test_index_reads_only_its_buckets(index):
    plan = index.lookup([Leaf("cat")])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,cat)" in plan


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "dog")], "id string, content string")
    assert [r["id"] for r in score_text(df, term("dog")).collect()] == ["c"]
    index = TextIndex.build(df)
    assert index.lengths.count() == 3 and index.totals.first()["n_docs"] == 3
    assert score_text(df.limit(0), term("dog")).collect() == []


def test_no_word():
    with pytest.raises(ValueError):
        term("...")


@pytest.mark.parametrize("every_word", [False, True])
@pytest.mark.parametrize("layout", [{}, {"max_broadcast": 1, "cell_queries": 2, "cell_elements": 90}])
@pytest.mark.parametrize("by", ["scan", "index"])
def test_batch(spark, corpus, index, every_word, layout, by):
    queries = {"q1": "dog mat", "q2": "cat Cat sat", "q3": "zebra", "q4": "...", "q5": "the the the cat mat dog ran"}
    asked = spark.createDataFrame(list(queries.items()), "query_id string, query string")
    if by == "scan":
        found = search_text_batch(asked, corpus, 4, every_word=every_word, digits=9, **layout).collect()
    else:
        found = index.search_batch(asked, 4, every_word=every_word, digits=9, **layout).collect()
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 8)) for r in found)
    expected = []
    for name, text in queries.items():
        words = query_tokens(text)
        if words:
            condition = all_of(*words) if every_word else any_of(*words)
            test = all if every_word else any
            hits = sorted((round(bm25(w, condition), 9), i) for i, w in CORPUS.items() if test(t in w for t in words))
            expected += [(name, n + 1, i, round(s, 8)) for n, (s, i) in enumerate(hits[:4])]
    assert got == sorted(expected)


def test_segments_equal_a_new_index(spark, corpus):
    stored = TextIndex.build(corpus).write(shared_dir(spark, "index"))
    first = spark.createDataFrame([("d04", "a new dog text"), ("x1", "dog dog mat"), ("x2", "")], "id string, content string")
    gone = spark.createDataFrame([("d05",), ("absent",)], "id string")
    second = spark.createDataFrame([("x1", "mat again"), ("d05", "the dog is back")], "id string, content string")
    index = stored.append(first, gone).append(second)
    with pytest.raises(ValueError):
        stored.append(second)  # read before the others were added
    after = corpus.where(~F.col("id").isin("d04", "d05")).unionByName(first.where("id <> 'x1'")).unionByName(second)
    wanted = TextIndex.build(after)
    assert tuple(index.totals.first()) == tuple(wanted.totals.first())
    for condition in (any_of("dog", "mat"), term("again"), phrase("dog", "text")):
        rows = [{r["id"]: round(r["score"], 9) for r in i.score(condition).collect()} for i in (index, wanted, index.write(shared_dir(spark, "index")))]
        assert rows[0] == rows[1] == rows[2] and rows[0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{index.path}/postings/segment=2").select("length")
    assert 0 < files.agg(F.sum("length")).first()[0] < 20_000
