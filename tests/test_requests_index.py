"""Requests over a stored index give what a scan gives, and read no text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import mutate, postings, search
from docloom.operators.embed import BatchEmbedder
from docloom.operators.postings import TextIndex
from docloom.session import shared_dir

DAY = "2025-01-01 00:00:00"
WORDS = ["the", "the", "the", "of", "of", "red", "fox", "foxes", "ran", "home", "rare"]
MATCHES = [
    {}, {"none": ["of"]}, {"phrases": ["the of"]}, {"prefixes": ["fox"]}, {"any": ["red", "rare"]}, {"any": ["the"], "none": ["of", "red"]},
    {"phrases": ["red fox ran"]}, {"phrases": ["the"], "prefixes": ["the fo"]}, {"none": ["absent"]}, {"prefixes": ["absent"]}, {"phrases": ["..."]},
]
FILTERS = [None, '{"tag": "en"}', '{"y": 1}', '{"tags": ["en", "hq"], "y": 2}', '{"z": "no"}']
SCHEMA = "query_id string, query string, type string, limit int, filters string, match string"


def toward(texts):
    return [[t.count("e") + 0.5, t.count("o") - 0.5] for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))
        vector = [rng.gauss(0, 1), rng.gauss(0, 1)] if i % 4 else None
        rows.append((f"d{i:03}", text, vector, rng.choice([["en"], ["en", "hq"], [], None]), rng.choice([None, '{"y": 1}', '{"y": 2}'])))
    frame = spark.createDataFrame(rows, "id string, content string, vector array<float>, tags array<string>, metadata string")
    path = shared_dir(spark, "docs")
    mutate.complete(frame, DAY).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(spark, docs):
    return TextIndex.build(docs).write(shared_dir(spark, "index"), buckets=3, splits=2)


def requests(spark, kinds=("fulltext", "vector", "hybrid", "")):
    asked = []
    for n, match in enumerate(MATCHES * 4):
        query = ["the", "red fox", "rare the home", "absent", "..."][n % 5]
        asked.append((f"q{n}", query, kinds[n // len(MATCHES) % len(kinds)], 1 + n % 6, FILTERS[n % len(FILTERS)], json.dumps(match)))
    return spark.createDataFrame(asked, SCHEMA)


def found(hits):
    return sorted((h["query_id"], h["type"], h["rank"], h["id"], h["score"]) for h in hits.withColumn("score", F.round("score", 8)).fillna(9, "score").collect())


def answer(docs, asked, **options):
    return found(search.search_requests(docs, asked, BatchEmbedder(toward, 2), digits=9, **options))


@pytest.mark.parametrize("every_word", [True, False])
def test_index_and_scan_agree(spark, docs, index, every_word):
    asked = requests(spark)
    hits = answer(docs, asked, every_word=every_word)
    assert len(hits) > 50
    assert answer(docs.drop("content"), asked, every_word=every_word, index=index) == hits


def test_many_candidates_and_several_passes(spark, docs, index, monkeypatch):
    asked = requests(spark)
    hits = answer(docs, asked)
    monkeypatch.setattr(postings, "BROADCAST_WORDS", 0)  # candidates are met by a join
    assert answer(docs.drop("content"), asked, index=index) == hits
    monkeypatch.setattr(search, "MATCHES_PER_PASS", 7)
    monkeypatch.setattr(search.path_groups, "__defaults__", (1,))
    layout = {"max_broadcast": 0, "cell_queries": 3, "cell_elements": 90}
    assert answer(docs.drop("content"), asked, index=index, **layout) == hits


def test_several_segments(spark, docs):
    old = docs.where("id < 'd200'").withColumn("content", F.when(F.col("id") < "d050", F.lit("the red fox of old")).otherwise(F.col("content")))
    stored = TextIndex.build(old).write(shared_dir(spark, "index"), buckets=3)
    stored = stored.append(docs.where("id >= 'd200' OR id < 'd050'"))
    asked = requests(spark, ("fulltext", "hybrid"))
    assert answer(docs.drop("content"), asked, index=stored) == answer(docs, asked)


def test_texts_without_filters_read_no_document(spark, docs, index):
    asked = spark.createDataFrame([("q", "rare", "fulltext", 3, None, '{"none": ["of"]}')], SCHEMA)
    gone = docs.where("1 = 0").drop("content")  # only postings decide
    assert answer(gone, asked, index=index) == answer(docs, asked) != []


def test_empty_index_and_no_requests(spark, docs, index):
    none = docs.where("id < 'a'")
    empty = TextIndex.build(none).write(shared_dir(spark, "index"))
    assert answer(none, requests(spark), index=empty) == []
    assert answer(docs, requests(spark).limit(0), index=index) == []
