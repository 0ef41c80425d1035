"""Whitening against exact integers and numpy."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa

from docloom.llm import whitening
from docloom.llm.queries import QUERIES
from docloom.llm.whitening import square_sums, whiten, whole_vectors


def expected(vectors, most=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    deviation = [int((row * row).sum()) for row in y]
    exact = [[Fraction(int(e), n) for e in (y[:, i] * y[:, j]).cumsum()[-1:]][0] / n / n for i in range(x.shape[1]) for j in range(x.shape[1])]
    covariance = np.array([float(e) for e in exact]).reshape(x.shape[1], -1)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1][:most], directions[:, ::-1][:, :most]
    return n, deviation, (y / n).astype(float) @ directions / np.sqrt(values), values / np.trace(covariance)


def check(rows, vectors, most=32):
    n, deviation, white, explained = expected(vectors, most)
    assert len(rows) == n and all(r["n"] == n for r in rows)
    assert [int(r["deviation"]) for r in rows] == deviation
    got = np.array([r["whitened"] for r in rows])
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got - white * signs).max() < 1e-9
    assert np.abs(np.array(rows[0]["explained"]) / explained - 1).max() < 1e-9
    assert all(0 <= r["identity_error"] < 1e-9 for r in rows)


def test_equal_to_exact_numbers(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 40)) * rng.uniform(0.1, 3, 40)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "c", 1.0, 2) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x string, index double, n int")
    check(sorted(whiten(df.repartition(7)).collect(), key=lambda r: r["vec_id"]), vectors.tolist())


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 1)  # 64 rows a block
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    check(sorted(whiten(df.repartition(5), most=3).collect(), key=lambda r: r["vec_id"]), vectors.tolist(), 3)


def test_what_is_left_out(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 4)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0, 3.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(sorted(whiten(df).collect(), key=lambda r: r["vec_id"]), good)


def test_repeated_and_null_ids_are_rows(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(30, 3)).tolist()
    df = spark.createDataFrame([(None if i < 3 else 7, v) for i, v in enumerate(good)], "vec_id long, embedding array<double>")
    rows = whiten(df).collect()
    assert len(rows) == 30 and sum(r["vec_id"] is None for r in rows) == 3


def test_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [float("nan")])]):
        assert whiten(spark.createDataFrame(rows, schema)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(9)], schema)  # one dimension never moves
    assert all(len(r["whitened"]) == 1 and r["identity_error"] < 1e-9 for r in whiten(flat).collect())


def test_exact_beyond_64_bits():
    y = np.array([[2**51, -(2**51) + 1, 3], [0, -1, 2**40]], dtype=np.int64)
    assert square_sums(y) == [sum(int(e) ** 2 for e in row) for row in y]


def test_entries_are_clipped():
    rows, x = whole_vectors(pa.array([[1e300, -1e300]], pa.list_(pa.float64())), 2)
    assert rows.tolist() == [0] and x.tolist() == [[64 * 2**40 + 1_000_000, -64 * 2**40 + 1_000_000]]


def test_query(spark):
    rows = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 500 * 32 and {r["component"] for r in rows} == set(range(1, 33))
    by = {k: [r["explained"] for r in rows if r["component"] == k][0] for k in range(1, 33)}
    assert all(by[k] >= by[k + 1] for k in range(1, 32))
