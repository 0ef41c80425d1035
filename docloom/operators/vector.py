"""Exact vector search: one query vector, or a table of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.filters import filter_column
from docloom.functions.vectors import WORST_DISTANCE, metric_name, score_block
from docloom.operators.fulltext import best
from docloom.operators.topk_join import SCORE_BLOCK, Best, Scorer, gates, rounded, size_of, topk_join
from docloom.schema import DEFAULT_LIMIT

TILE_ROWS = 2048  # documents whose products with queries are computed at a time
TILE_PAIRS = 1 << 18  # products computed at a time: they stay in a core's cache
FIRST_ROWS = 512  # documents scored against a query of which nothing is known
NEAR_PAIRS = 500_000  # pairs computed again at a time
CELL_PAIRS = 250_000_000  # pairs that make a cell worth its task
CELLS_PER_CORE = 4
LENGTHS = 1e-100, 1e100  # of vectors whose squares and their products stay finite


def vectors_by_length(lists: pa.Array):
    """``(length, row numbers, matrix)`` for each vector length."""
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        values = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield length, rows, values.astype("float64").reshape(len(rows), length)


def score_lists(metric: str, docs: pa.Array, queries: list) -> np.ndarray:
    n_queries = sum(len(rows) for _, rows, _ in queries)
    unequal = WORST_DISTANCE if metric == "euclidean" else 0.0
    out = np.full((len(docs), n_queries), unequal)
    for length, rows, matrix in vectors_by_length(docs):
        for query_length, columns, query_matrix in queries:
            if length == query_length:
                out[np.ix_(rows, columns)] = score_block(metric, matrix, query_matrix)
    return np.where(np.isnan(out), WORST_DISTANCE, out)  # not a number: the last rank, in every search


def similarity_to(vector: list[float], metric="cosine", column="vector"):
    """Score of a vector column against one fixed vector (Arrow batches)."""
    metric = metric_name(metric)
    query = np.asarray(vector, "float32").astype("float64")

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        wanted = [(len(query), np.array([0]), query[None, :])]
        return pa.array(score_lists(metric, vectors, wanted)[:, 0])

    return score(F.col(column))


def embedded(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """Documents that carry a vector and pass the filters."""
    has_vector = F.col("is_embedded") & (F.size("vector") > 0)
    return df.where(has_vector & filter_column(filters))


def score_vectors(df: DataFrame, vector: list[float], metric="cosine", filters: dict | None = None) -> DataFrame:
    """Every embedded document with its ``score``, higher is better."""
    return embedded(df, filters).withColumn("score", similarity_to(vector, metric))


def search_vectors(
    df: DataFrame,
    vector: list[float],
    k: int | None = None,
    metric="cosine",
    filters: dict | None = None,
    id="id",
    digits: int | None = None,
) -> DataFrame:
    """The k most similar documents with ``score`` and ``rank``.

    Without a limit all are ranked. ``digits`` rounds scores before ranking.
    A score that is not a number ranks last.
    """
    scored = score_vectors(df, vector, metric, filters)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return best(scored, k, id, descending=True)


class _Directions:
    """Vectors of one length with a direction: their row numbers, values and
    norms, and the unit vectors in single precision."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray):
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        good = (norms >= LENGTHS[0]) & (norms <= LENGTHS[1])
        self.rows, self.odd = rows[good], rows[~good]
        self.matrix, self.norms = matrix[good], norms[good]
        self.unit = (self.matrix / self.norms[:, None]).astype("float32")

    def cosines(self, d: np.ndarray, other: _Directions, q: np.ndarray) -> np.ndarray:
        """As ``score_block`` has them, for pairs."""
        return np.einsum("ij,ij->i", self.matrix[d], other.matrix[q]) / (self.norms[d] * other.norms[q])


def _near(docs: _Directions, start: int, queries: _Directions, asking: np.ndarray, limits: np.ndarray):
    """``(documents, queries)`` in portions: at least all pairs of the documents
    from ``start`` on whose cosine reaches the query's limit.

    Products of unit vectors in single precision are off by less than half of
    ``margin``, whatever the order of their sums.
    """
    unit = docs.unit[start:]
    margin = (unit.shape[1] + 8) * 2.0**-23
    limits = np.nextafter((limits - margin).astype("float32"), np.float32(-np.inf))
    step = max(1, TILE_PAIRS // len(unit))
    products = np.empty((step, len(unit)), "float32")
    found, n = [], 0
    for at in range(0, len(asking), step):
        own = asking[at : at + step]
        tile, limit = products[: len(own)], limits[at : at + step]
        np.matmul(queries.unit[own], unit.T, out=tile)
        some = np.flatnonzero(tile.max(axis=1) >= limit)  # most queries have none here
        if len(some):
            q, d = np.divmod(np.flatnonzero(tile[some] >= limit[some, None]), len(unit))
            found.append((d + start, own[some[q]]))
            n += len(q)
            if n >= NEAR_PAIRS:
                yield tuple(map(np.concatenate, zip(*found)))
                found, n = [], 0
    if found:
        yield tuple(map(np.concatenate, zip(*found)))


class VectorScorer(Scorer):
    """Queries and documents both have a ``vector`` column."""

    def __init__(self, metric="cosine"):
        self.metric = metric_name(metric)

    def prepare(self, queries):
        return list(vectors_by_length(queries["vector"].chunk(0)))

    def arranged(self, docs):
        """In no order, so that the best are not all among the last."""
        return docs.take(pa.array(np.random.default_rng(0).permutation(docs.num_rows)))

    def scores(self, state, docs):
        return score_lists(self.metric, docs.column("vector"), state), None

    def least_cells(self, pairs, cores):
        return max(1, min(CELLS_PER_CORE * cores, -(-pairs // CELL_PAIRS)))

    def vectors(self, state) -> list:
        """The queries as ``prepare`` has them."""
        return state

    def meetings(self, state, docs: pa.RecordBatch):
        """``(documents, queries)`` that are compared, as row numbers."""
        yield np.arange(docs.num_rows), np.arange(sum(len(rows) for _, rows, _ in state))

    def search(self, state, batches, best: Best):
        """Cosines are found by products in single precision, and only pairs
        that can reach the floor of their query are computed in double; all
        other scores are computed as they are."""
        vectors = self.vectors(state)
        queries = {length: _Directions(rows, matrix) for length, rows, matrix in vectors} if self.metric == "cosine" else {}
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_ROWS):
                docs = batch.slice(at, TILE_ROWS)
                for rows, columns in self.meetings(state, docs):
                    if len(columns):
                        self._meet(docs.take(pa.array(rows)) if len(rows) < docs.num_rows else docs, columns, vectors, queries, best)
        return True

    def _meet(self, docs: pa.RecordBatch, columns: np.ndarray, vectors: list, queries: dict, best: Best):
        for length, rows, matrix in vectors_by_length(docs.column("vector")):
            others = columns
            if length in queries:
                own, of = _Directions(rows, matrix), queries[length]
                asked = np.isin(of.rows, columns, assume_unique=True) if len(columns) < len(best.ks) else np.full(len(of.rows), True)
                self._meet_directions(docs, own, of, np.flatnonzero(asked), vectors, best)
                self._meet_all(docs, own.odd, columns, vectors, best)
                rows, others = own.rows, np.setdiff1d(columns, of.rows[asked], assume_unique=True)
            self._meet_all(docs, rows, others, vectors, best)

    def _meet_directions(self, docs, own: _Directions, of: _Directions, asking: np.ndarray, vectors: list, best: Best):
        ids, slack, at = docs.column("id"), 0.0 if best.digits is None else 10.0**-best.digits, 0
        while len(asking) and at < len(own.rows):
            floor = best.floor[of.rows[asking]]
            known, unknown = asking[floor > -np.inf], asking[floor == -np.inf]
            if len(known):
                for d, q in _near(own, at, of, known, floor[floor > -np.inf] - slack):
                    scores = own.cosines(d, of, q)
                    best.add_pairs(ids, own.rows[d], of.rows[q], scores if best.digits is None else rounded(scores, best.digits))
            if len(unknown):
                self._meet_all(docs, own.rows[at : at + FIRST_ROWS], of.rows[unknown], vectors, best)
                best.settle()
            asking, at = unknown, at + FIRST_ROWS

    def _meet_all(self, docs, rows: np.ndarray, columns: np.ndarray, vectors: list, best: Best):
        """All scores of some documents for some queries, in blocks."""
        step = min(len(rows), FIRST_ROWS)
        for at in range(0, len(rows) if len(columns) else 0, max(1, step)):
            part = docs.take(pa.array(rows[at : at + step]))
            for first in range(0, len(columns), SCORE_BLOCK // step):
                some = columns[first : first + SCORE_BLOCK // step]
                place = np.full(len(best.ks), -1)
                place[some] = np.arange(len(some))
                asking = [(length, place[own][mine], matrix[mine]) for length, own, matrix in vectors if (mine := place[own] >= 0).any()]
                scores = score_lists(self.metric, part.column("vector"), asking)
                best.add(part.column("id"), scores if best.digits is None else rounded(scores, best.digits), None, some)


def knn_join(
    queries: DataFrame, docs: DataFrame, k: int = DEFAULT_LIMIT, metric="cosine", digits: int | None = None, **layout
) -> DataFrame:
    """The k nearest documents of every query vector.

    ``queries``: ``query_id, vector`` and optionally ``k`` and ``filter_no``;
    ``docs``: ``id, vector``, and ``passes`` if ``filter_no`` is used. A query
    without a vector has no neighbours.
    """
    queries = queries.where(F.size("vector") > 0)
    if "k" not in queries.columns:
        queries = queries.withColumn("k", F.lit(int(k)))
    queries = queries.select("query_id", "vector", "k", *(c for c in ("filter_no", "conditions") if c in queries.columns))
    docs = docs.where(F.size("vector") > 0).select("id", "vector", *gates(queries))
    size = F.size("vector")
    return topk_join(queries, docs, VectorScorer(metric), size_of(queries, size), size, digits, **layout).drop("tie")


def dimension_report(df: DataFrame, dim: int, column="vector") -> DataFrame:
    """Vectors per length, with whether the length is the expected one."""
    by_length = df.groupBy(F.coalesce(F.size(column), F.lit(0)).alias("dim")).agg(F.count("*").alias("n"))
    return by_length.withColumn("as_expected", F.col("dim") == dim)
