"""Many filters at once against each filter on its own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.functions.filters import filter_column
from docloom.operators import filter_join, search, topk_join
from docloom.operators.embed import StubEmbedder
from docloom.operators.filter_join import FilterTable, conditions_of, passing
from docloom.operators.search import search_requests
from docloom.schema import DOCUMENT_SCHEMA

VALUES = [1, 0, True, False, 1.0, 2024, 2024.0, 2.024e3, "2024", "1", "true", None, "null", [1, "z"], {"b": 1, "a": [2]}, "a\x1fn:5", "", 2**53, 2**53 + 1, 2**60 + 1, -0.0, 0.1, 1e300, "été", "x:"]
FILTERS = [{"v": v} for v in VALUES] + [
    {}, {"tag": "en"}, {"tags": ["en", "hq"]}, {"tags": "hq"}, {"tags": [3, "hq"]}, {"tags": []}, {"v": 1, "tag": "en"}, {"deep.w": 1, "v": True},
    {"deep.list[1]": 2}, {"absent": None}, {"tag": "x,y"}, {"v": {"a": [2], "b": 1}}, {"deep": {"list": [1, 2], "w": 1}}, {"tag": "en", "tags": ["en"], "v": "1"},
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = []
    for n in range(150):
        deep = {"w": rng.choice([1, 1.0, True, "1"]), "list": rng.choice([[1, 2], [1], [1, 2.0]])}
        metadata = json.dumps({"v": VALUES[n % len(VALUES)], "deep": deep}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        tags = rng.choice([None, [], ["en"], ["en", "hq"], ["hq", "en", "en"], ["x,y"]])
        rows.append((f"d{n:03}", f"text {n % 7}", rng.choice([metadata] * 8 + [None, "not json"]), tags, [float(n), 1.0], None, None, True))
    return spark.createDataFrame(rows, DOCUMENT_SCHEMA)


def expected(docs, filters):
    found = docs.select("id", *(filter_column(f).alias(f"f{n}") for n, f in enumerate(filters))).collect()
    return {(r["id"], n) for r in found for n, f in enumerate(filters) if conditions_of(json.dumps(f)) and r[f"f{n}"]}


@pytest.mark.parametrize("most", [256, 1])
def test_equal_to_each_filter(spark, docs, monkeypatch, most):
    monkeypatch.setattr(filter_join.path_groups, "__defaults__", (most,))
    asked = spark.createDataFrame([(n, json.dumps(f)) for n, f in enumerate(FILTERS)], "filter_no int, filters string")
    found = [(r["id"], r["filter_no"]) for r in passing(docs, asked).collect()]
    assert len(found) == len(set(found)) and set(found) == expected(docs, FILTERS)


def test_wrong_kinds_and_nothing(spark, docs):
    bad = ['{"tag": 3}', "[1]", "{", '{"a..b": 1}', None, "{}", '{"a\x1fb": 1}']
    asked = spark.createDataFrame(list(enumerate(bad)), "filter_no int, filters string")
    assert passing(docs, asked).collect() == [] and passing(docs, asked.limit(0)).collect() == []
    assert [conditions_of(f) for f in bad[:4]] == [None] * 4


def test_filter_table_in_parts(spark, docs, monkeypatch):
    asked = [conditions_of(json.dumps(f)) for f in FILTERS]
    paths = sorted({p for c in asked for p, _ in c if p})
    frame = spark.createDataFrame([(n, json.dumps(f)) for n, f in enumerate(FILTERS)], "n int, filters string")
    lists = [r["c"] for r in frame.orderBy("n").select(filter_join.compiled("filters").alias("c")).collect()]
    table = docs.select("id", filter_join.facts(paths).alias("facts")).toArrow().combine_chunks()
    whole = FilterTable(lists).passes(table["facts"].chunk(0))
    monkeypatch.setattr(filter_join, "PAIRS", 3)
    assert (FilterTable(lists).passes(table["facts"].chunk(0)) == whole).all()
    ids = table["id"].to_pylist()
    met = {(ids[i], n) for i, n in zip(*whole.nonzero()) if asked[n]}
    assert met == expected(docs, FILTERS) and whole[:, FILTERS.index({})].all()


@pytest.mark.parametrize("layout", [{}, {"max_broadcast": 1, "cell_queries": 200, "cell_elements": 300}])
def test_a_thousand_requests_with_filters_of_their_own(spark, docs, layout):
    rng = random.Random(9)
    filters = [rng.choice(FILTERS) | ({f"k{n}": n} if n % 3 == 0 else {}) for n in range(1000)]
    kinds = [("fulltext", "vector", "hybrid")[n % 3] for n in range(1000)]
    rows = [(n, f"text {n % 7}", kind, 4, json.dumps(f)) for n, (f, kind) in enumerate(zip(filters, kinds))]
    asked = spark.createDataFrame(rows, "query_id int, query string, type string, limit int, filters string")
    found = search_requests(docs, asked, StubEmbedder(2), **layout).collect()
    passed, bodies = {}, {r["id"]: r["content"] for r in docs.collect()}
    every = docs.select("id", *(filter_column(f).alias(f"f{n}") for n, f in enumerate(FILTERS))).collect()
    for n, f in enumerate(filters):
        base = FILTERS.index({k: v for k, v in f.items() if not k.startswith("k")})
        passed[n] = {r["id"] for r in every if r[f"f{base}"]} if len(f) == len(FILTERS[base]) else set()
    for n, kind in enumerate(kinds):
        mine = [r["id"] for r in found if r["query_id"] == n]
        fits = {i for i in passed[n] if kind == "vector" or bodies[i] == f"text {n % 7}"}
        assert set(mine) <= fits and len(mine) == min(4, len(fits))


def test_filters_meet_documents_over_their_rarest_condition(spark):
    own = [(f"d{n}", json.dumps({"no": n}), ["en"]) for n in range(300)]
    docs = spark.createDataFrame(own, "id string, metadata string, tags array<string>")
    asked = spark.createDataFrame([(n, json.dumps({"no": n, "tag": "en"})) for n in range(400)], "filter_no int, filters string")
    told = docs.select("id", filter_join.facts(["no"]).alias("facts"))
    keys = filter_join.rarest(asked.select(filter_join.compiled("filters").alias("conditions")), told)
    assert {(r["n"], r["fact"].startswith("no")) for r in keys.collect()} == {(1, True)} and keys.count() == 300
    assert filter_join.with_keys(told, keys.select("fact", "conditions")).count() == 300  # not 300 x 300
    assert {tuple(r) for r in passing(docs, asked).collect()} == {(f"d{n}", n) for n in range(300)}


def test_repeated_rows_pass_once(spark, docs):
    """Half of the conditions met by a row that comes twice are not all of them."""
    asked = spark.createDataFrame([(n, json.dumps(f)) for n, f in enumerate(FILTERS)] * 2, "filter_no int, filters string")
    found = [(r["id"], r["filter_no"]) for r in passing(docs.union(docs), asked).collect()]
    assert len(found) == len(set(found)) and set(found) == expected(docs, FILTERS)


def test_filtered_requests_meet_documents_by_condition(spark, monkeypatch):
    """Cells of a few conditions, split by queries and by documents, give what the broadcast layout gives."""
    rows = [(f"d{n:03}", "a b " + "c " * (n % 5), json.dumps({"no": n % 90}), ["en"] if n % 2 else ["fr", "hq"], None, None, None, False) for n in range(180)]
    docs = spark.createDataFrame(rows, DOCUMENT_SCHEMA)
    asks = [{"no": n % 100, "tag": "en"} for n in range(120)] + [{"tag": "fr"}, {"tag": "hq"}, {}, {"tag": "absent"}] * 3
    asked = spark.createDataFrame([(str(n), "a c", "", 3, json.dumps(f)) for n, f in enumerate(asks)], "query_id string, query string, type string, limit int, filters string")
    answer = lambda **layout: sorted(search_requests(docs, asked, StubEmbedder(2), every_word=False, digits=9, **layout).collect())
    expected = answer()
    monkeypatch.setattr(topk_join, "KEYED_QUERIES", 8)
    assert answer(max_broadcast=0, cell_queries=2, cell_elements=40) == expected
    assert answer(max_broadcast=0) == expected

    told = docs.select("id", filter_join.facts(["no"]).alias("facts"))
    queries = asked.select("query_id", filter_join.compiled("filters").alias("conditions")).where("query_id < 100")
    left, right = topk_join._keyed(queries.where(F.size("conditions") > 1), told, 100, F.lit(0), 1000, 1000)
    cells = ["_cell", "_q", "_d"]
    pairs = left.groupBy(cells).count().join(right.groupBy(cells).agg(F.count("*").alias("n")), cells).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert pairs <= 100 * 180 / 8


def test_equal_requests_are_answered_once(spark):
    asked = spark.createDataFrame([(f"q{n}", "a", "fulltext", 3, "{}", "{}", []) for n in range(50)], "query_id string, query string, type string, k int, filters string, match string, conditions array<string>")
    first, members = search._distinct(asked)
    assert [r["query_id"] for r in first.collect()] == ["q0"]
    assert {(r["query_id"], r["type"], r["first"]) for r in members.collect()} == {(f"q{n}", "fulltext", "q0") for n in range(50)}
