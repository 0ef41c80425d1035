"""Metrics, nearest neighbours in both layouts, blobs, payloads."""

import random
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions.payloads import parse_payload
from docloom.functions.tags import tags_from_csv, tags_to_csv
from docloom.functions.vectors import blob_to_vector, score_block, similarity, vector_to_blob
from docloom.operators import topk_join, vector
from docloom.operators.vector import dimension_report, knn_join, score_vectors, search_vectors

WORST = -sys.float_info.max
PAIRS = [
    ([1.0, 0.0], [1.0, 0.0], 1.0, 0.0, 1.0),
    ([1.0, 0.0], [0.0, 1.0], 0.0, -(2**0.5), 0.0),
    ([1.0, 0.0], [-1.0, 0.0], -1.0, -2.0, -1.0),
    ([0.0, 0.0], [1.0, 0.0], 0.0, -1.0, 0.0),
    ([1.0, 0.0, 0.0], [1.0, 0.0], 0.0, WORST, 0.0),
]


@pytest.mark.parametrize("pair", PAIRS)
def test_metrics(spark, pair):
    a, b, *expected = pair
    df = spark.createDataFrame([("x", a, b, True, [], "null")], "id string, vector array<float>, b array<float>, is_embedded boolean, tags array<string>, metadata string")
    for metric, value in zip(("cosine", "euclidean", "dot"), expected):
        assert df.select(similarity(metric, "vector", "b")).first()[0] == pytest.approx(value)
        assert score_vectors(df, b, metric).first()["score"] == pytest.approx(value)
    assert score_vectors(df, b, "no such metric").first()["score"] == pytest.approx(expected[0])


_random = random.Random(3)
VECTORS = {f"v{i:03}": [float(_random.randrange(-3, 4)) for _ in range(4)] for i in range(200)}
VECTORS["v000"] = [0.0] * 4
VECTORS["v001"] = [1.0, 2.0]


def score(metric, a, b):
    if len(a) != len(b):
        return WORST if metric == "euclidean" else 0.0
    a, b = np.array(a), np.array(b)
    if metric == "euclidean":
        return -float(np.linalg.norm(a - b))
    if metric == "dot":
        return float(a @ b)
    norms = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / norms if norms else 0.0


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(VECTORS.items()), "id string, vector array<float>").repartition(5)


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("layout", [{}, {"max_broadcast": 30, "cell_queries": 70, "cell_elements": 300}])
def test_knn_join(table, metric, layout):
    queries = table.select(F.col("id").alias("query_id"), "vector")
    found = knn_join(queries, table, 6, metric, digits=6, **layout).collect()
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in found)
    expected = []
    for name, q in VECTORS.items():
        ranked = sorted((-round(score(metric, q, v), 6), i) for i, v in VECTORS.items())[:6]
        expected += [(name, n + 1, i) for n, (_, i) in enumerate(ranked)]
    assert got == sorted(expected)


def test_distances_of_near_vectors():
    docs = np.array([[1e3, 1e3], [1e3 + 1e-5, 1e3], [0.0, 0.0], [-5.0, 2.0]])
    exact = np.sqrt(((docs[:, None, :] - docs[None, :, :]) ** 2).sum(-1))
    assert np.allclose(-score_block("euclidean", docs, docs), exact, rtol=1e-11, atol=0)


def test_knn_fewer_than_k_and_own_k(table):
    few = table.where(F.col("id") < "v004")
    queries = few.select(F.col("id").alias("query_id"), "vector", F.when(F.col("id") == "v002", 2).otherwise(9).alias("k"))
    counts = {r["query_id"]: r["count"] for r in knn_join(queries, few).groupBy("query_id").count().collect()}
    assert counts == {"v000": 4, "v001": 4, "v002": 2, "v003": 4}
    assert knn_join(queries.limit(0), few).collect() == []


def test_search_vectors(table):
    docs = table.withColumns({"is_embedded": F.col("id") != "v007", "tags": F.array(F.substring("id", 4, 1)), "metadata": F.lit("null")})
    q = VECTORS["v007"]
    ranked = sorted((-round(score("cosine", q, v), 6), i) for i, v in VECTORS.items() if i != "v007" and i[3] == "5")[:4]
    hits = search_vectors(docs, q, 4, filters={"tag": "5"}, digits=6).orderBy("rank").collect()
    assert [h["id"] for h in hits] == [i for _, i in ranked] and [h["rank"] for h in hits] == [1, 2, 3, 4]


def test_blobs(spark):
    df = spark.createDataFrame([("a", [1.5, -2.0]), ("b", []), ("c", None)], "id string, v array<float>")
    back = df.select("id", vector_to_blob("v").alias("blob")).select("id", "blob", blob_to_vector("blob").alias("v"))
    rows = {r["id"]: r for r in back.collect()}
    assert rows["a"]["v"] == [1.5, -2.0] and bytes(rows["a"]["blob"]) == np.array([1.5, -2.0], "<f4").tobytes()
    assert rows["b"]["v"] is None and rows["c"]["v"] is None
    trailing = spark.createDataFrame([(rows["a"]["blob"] + b"xyz",)], "blob binary")
    assert trailing.select(blob_to_vector("blob")).first()[0] == [1.5, -2.0]


def test_dimension_report(table):
    rows = {r["dim"]: (r["n"], r["as_expected"]) for r in dimension_report(table, 4).collect()}
    assert rows == {4: (199, True), 2: (1, False)}


PAYLOADS = [
    ("[1, 2.5]", [1.0, 2.5], None),
    ('{"embedding": [1, 2], "model": "m"}', [1.0, 2.0], None),
    ('[{"index": 0, "embedding": [[3, 4], [5, 6]]}, {"index": 1, "embedding": [[7, 8]]}]', [3.0, 4.0], None),
    ("[1, 2, 3]", None, "dimension is not 2 but 3"),
    ('{"embedding": []}', None, 'no embedding in answer: {"embedding": []}'),
    ("[]", None, "no embedding in answer: []"),
    ('["1", "2"]', None, 'no embedding in answer: ["1", "2"]'),
    ("oops" + "x" * 300, None, "no embedding in answer: oops" + "x" * 196 + "..."),
    (None, None, "no embedding in answer: "),
]


@pytest.mark.parametrize("case", PAYLOADS, ids=range(len(PAYLOADS)))
def test_payloads(spark, case):
    raw, vector, error = case
    row = spark.createDataFrame([(raw,)], "raw string").select(parse_payload("raw", 2).alias("p")).first()["p"]
    assert (row["vector"], row["error"]) == (vector, error)


@pytest.mark.parametrize("tags", [["tag1"], ["tag1", "tag2", "tag3"], ["tag-1", "tag_2", "tag.3"], [], None])
def test_tag_text(spark, tags):
    df = spark.createDataFrame([(tags,)], "tags array<string>").select(tags_to_csv("tags").alias("csv"))
    assert df.select(tags_from_csv("csv")).first()[0] == (tags or [])


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("k", [1, 2, 9])
def test_scores_that_are_no_number_rank_last(spark, metric, k):
    rows = [("a", [1.0, 0.0], True), ("b", [float("nan"), 1.0], True), ("c", [0.5, 0.5], True)]
    docs = spark.createDataFrame(rows, "id string, vector array<float>, is_embedded boolean")
    asked = spark.createDataFrame([("q", [1.0, 0.2]), ("none", None)], "query_id string, vector array<float>")
    joined = vector.knn_join(asked, docs, k, metric).orderBy("rank").collect()
    single = vector.search_vectors(docs, [1.0, 0.2], k, metric).orderBy("rank").collect()
    assert [r["id"] for r in joined] == [r["id"] for r in single] == ["a", "c", "b"][:k]
    assert {r["query_id"] for r in joined} == {"q"}


def run_cell(scorer, docs, asked, digits, each=(1, 5, 40, 5000)):
    lists = lambda rows: pa.array([None if r is None else list(map(float, r)) for r in rows], pa.list_(pa.float32()))
    ids, names = [f"d{i * 7 % len(docs):05}" for i in range(len(docs))], [f"q{i}" for i in range(len(asked))]
    ks = pa.array([each[i % len(each)] for i in range(len(asked))], pa.int32())
    queries = pa.table({"query_id": names, "vector": lists(asked), "k": ks})
    out = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64()), ("tie", pa.float64()), ("k", pa.int32())])
    rows = topk_join._run_cell(scorer, queries, pa.table({"id": ids, "vector": lists(docs)}), out, digits).to_pylist()
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], -r["score"], r["id"])):
        found.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6) + 0.0))
    return ids, names, ks.to_pylist(), found


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
@pytest.mark.parametrize("digits", [6, None])
def test_a_cell_finds_what_all_scores_give(monkeypatch, metric, digits):
    """Growing likeness, copies, and vectors without a direction or of another length."""
    for name, value in {"TILE_ROWS": 100, "TILE_PAIRS": 2000, "FIRST_ROWS": 16, "NEAR_PAIRS": 300}.items():
        monkeypatch.setattr(vector, name, value)
    monkeypatch.setattr(topk_join, "WAITING_ROWS", 50)
    monkeypatch.setattr(vector.VectorScorer, "arranged", lambda self, docs: docs)
    rng = np.random.default_rng(2)
    aim, near = rng.normal(size=8), rng.normal(size=(300, 8))
    docs = [aim + near[i] * (300 - i) / 30 for i in range(300)] + [aim] * 30 + list(rng.normal(size=(200, 8)))
    docs = [np.asarray(d, "float32") for d in docs] + [np.zeros(8), np.full(8, 1e-40), np.full(8, 3e38 if metric == "cosine" else 3.0), np.arange(3.0), np.full(8, np.nan), [np.inf] + [1.0] * 7]
    asked = [docs[i] for i in (299, 310, 400, 0, *range(-6, 0))] + list(rng.normal(size=(40, 8)).astype("float32"))
    ids, names, ks, found = run_cell(vector.VectorScorer(metric), docs, asked, digits)
    lists = lambda rows: pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float32()))
    with np.errstate(all="ignore"):
        every = vector.score_lists(metric, lists(docs), list(vector.vectors_by_length(lists(asked))))
    for n, (name, k) in enumerate(zip(names, ks)):
        scores = every[:, n] if digits is None else topk_join.rounded(every[:, n], digits)
        best = sorted((-s, i) for s, i in zip(scores, ids) if s > -np.inf)[:k]  # at no finite distance: no result
        assert [s for _, s in found[name]] == [round(float(-s), 6) + 0.0 for s, _ in best]
        assert digits is None or [i for i, _ in found[name]] == [i for _, i in best]


def test_few_pairs_of_a_cell_are_computed_in_double(monkeypatch):
    pairs, plain = [], vector.score_lists

    def counted(metric, docs, queries):
        pairs.append(len(docs) * sum(len(rows) for _, rows, _ in queries))
        return plain(metric, docs, queries)

    monkeypatch.setattr(vector, "score_lists", counted)
    near = vector._Directions.cosines
    monkeypatch.setattr(vector._Directions, "cosines", lambda self, d, other, q: pairs.append(len(d)) or near(self, d, other, q))
    rng = np.random.default_rng(3)
    docs, asked = rng.normal(size=(20_000, 16)), rng.normal(size=(40, 16))
    topk = run_cell(vector.VectorScorer(), docs, asked, 6, (1, 5))[3]
    assert len(topk) == 40 and sum(pairs) < 0.05 * 20_000 * 40


def test_cells_follow_the_pairs(table, monkeypatch):
    monkeypatch.setattr(vector, "CELL_PAIRS", 1000)
    queries = table.select(F.col("id").alias("query_id"), "vector", F.lit(3).alias("k"))
    left, right = topk_join._cut(queries, table, vector.VectorScorer(), 200, 1000, F.size("vector"), 1000, 10_000)
    cells = [{(r["_q"], r["_d"]) for r in side.select("_q", "_d").distinct().collect()} for side in (left, right)]
    assert cells[0] == cells[1] and len(cells[0]) >= 4 * table.sparkSession.sparkContext.defaultParallelism
    assert left.count() + right.count() < 15 * 200
