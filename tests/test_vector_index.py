"""Neighbours found through bounds are those of the full comparison."""

import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import topk_join
from docloom.operators.vector import knn_join
from docloom.operators.vector_index import OTHER, BlockScorer, VectorIndex
from docloom.session import shared_dir


def clustered(seed=5, n=1200, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (12, dim))
    rows = [(f"v{i:04}", (centres[i % 12] + rng.normal(0, 0.3, dim)).astype("float32").tolist()) for i in range(n)]
    rows += [(f"same{i:03}", [1.0] * dim) for i in range(400)]  # one vector that many rows share
    odd = [[0.0] * dim, [float("nan")] * dim, [float("inf")] * dim, [1.0, 2.0], [], None]
    return rows + [(f"odd{i}", vector) for i, vector in enumerate(odd)]


@pytest.fixture(scope="module")
def docs(spark):
    path = shared_dir(spark, "vectors")
    spark.createDataFrame(clustered(), "id string, vector array<float>").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module", params=["cosine", "euclidean"])
def index(spark, docs, request):
    return VectorIndex.write(docs, shared_dir(spark, "index"), request.param, pivots=10, rings=4, file_rows=100)


def queries(docs, k="10"):
    asked = docs.where("id LIKE 'odd%' OR id LIKE 'v%0' OR id LIKE 'v%7' OR id IN ('same001', 'same002')")
    return asked.select(F.col("id").alias("query_id"), "vector", F.expr(k).cast("int").alias("k"))


def found(hits):
    return sorted((h["query_id"], h["rank"], h["id"], repr(round(h["score"], 6) + 0.0)) for h in hits.collect())


@pytest.mark.parametrize("k", ["10", "1 + length(query_id) * 300"])
def test_same_neighbours(docs, index, k):
    asked = queries(docs, k.replace("query_id", "id"))
    assert found(index.knn_join(asked, digits=6)) == found(knn_join(asked, docs, metric=index.metric, digits=6))


def test_many_queries_in_cells(docs, index):
    asked, layout = queries(docs), {"max_broadcast": 0, "cell_queries": 40, "cell_elements": 3000}
    assert found(index.knn_join(asked, digits=6, **layout)) == found(knn_join(asked, docs, metric=index.metric, digits=6))


def test_most_blocks_are_passed_over(docs, index):
    asked = index.asked(queries(docs).where("query_id LIKE 'v%'"), digits=6)
    shares = [r["share"] for r in index.share(asked).collect()]
    assert len(shares) == 240 and np.mean(shares) < 0.35
    one = index.asked(queries(docs).where("query_id = 'v0010'"), digits=6)
    hits = index._hits(one, 6, {})
    assert len(one.first()["blocks"]) < len(index.blocks) / 2 and hits.count() == 10


def test_layout(docs, index):
    rows = index.vectors().groupBy("block").agg(F.count("*").alias("n")).collect()
    assert {r["block"]: r["n"] for r in rows} == dict(zip(index.blocks.tolist(), index.n.tolist()))
    others = {r["id"] for r in index.vectors().where(F.col("block") == OTHER).collect()}
    assert others == {"odd1", "odd2", "odd3"} | ({"odd0"} if index.metric == "cosine" else set())
    hot = index.vectors().where("id LIKE 'same%'").select(F.input_file_name()).distinct().count()
    assert hot > 1  # the shared vector is spread over files


def test_no_vectors_and_no_queries(spark, docs, index):
    none = docs.where("1 = 0")
    empty = VectorIndex.write(none, shared_dir(spark, "index"))
    assert empty.knn_join(queries(docs)).collect() == []
    assert index.knn_join(queries(docs).where("1 = 0")).collect() == []
    with pytest.raises(ValueError, match="dot"):
        VectorIndex.write(docs, "unused", "dot")


def test_a_task_holds_each_query_once(spark):
    """However many blocks it asks for."""
    vectors = np.random.default_rng(1).normal(size=(300, 64)).astype("float32")
    queries = pa.table({"vector": pa.array(vectors.tolist(), pa.list_(pa.float32())), "blocks": pa.array([list(range(200))] * 300, pa.list_(pa.int32()))})
    scorer = BlockScorer("cosine")
    state = scorer.prepare(queries)
    assert len(pickle.dumps(state)) < 300 * 64 * 8 + 300 * 200 * 8 + 100_000
    docs = pa.table({"vector": queries["vector"], "block": pa.array([n % 250 for n in range(300)], pa.int32())}).combine_chunks()
    scores = scorer.scores(state, scorer.arranged(docs).combine_chunks().to_batches()[0])[0]
    assert np.isfinite(scores[:250]).all() and (scores[250:] == -np.inf).all()


def test_a_cell_has_only_queries_that_ask_for_its_blocks(spark, docs, index):
    asked = index.asked(queries(docs).where("query_id LIKE 'v%'"), digits=6)
    assert asked.where("goal IS NULL OR goal = double('-inf')").count() == 0  # the second pass knows what to beat
    stored = index.vectors().select("id", "vector", "block")
    left, right = topk_join._by_block(asked, stored, BlockScorer(index.metric), F.size("vector"), 100, 3000)
    sent = {}
    for r in right.select("_cell", "_q", "_d", "id", "block").collect():
        sent.setdefault((r["_cell"], r["_q"], r["_d"]), set()).add((r["id"], r["block"]))
    met = set()
    for r in left.collect():
        here = sent.get((r["_cell"], r["_q"], r["_d"]), set())
        assert r["blocks"] and set(r["blocks"]) <= {b for cell, rows in sent.items() if cell[0] == r["_cell"] for _, b in rows}
        pairs = {(r["query_id"], i) for i, b in here if b in r["blocks"]}
        assert not pairs & met
        met |= pairs
    of_block = {}
    for r in stored.collect():
        of_block.setdefault(r["block"], []).append(r["id"])
    assert met == {(r["query_id"], i) for r in asked.collect() for b in r["blocks"] for i in of_block[b]}
    assert left.count() < 0.6 * asked.count() * len({cell[0] for cell in sent})
