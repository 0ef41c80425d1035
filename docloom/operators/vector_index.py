"""Exact nearest neighbours without comparing every vector.

Vectors are stored in blocks: by the nearest of some pivots, and inside that by
rings of distance from it. A small dictionary keeps, per block and pivot, the
least and the largest distance of its vectors to the pivot. By the triangle
inequality that bounds the score of a whole block for a query, so a search
looks into the most promising blocks first, and then only into those that can
still hold one of the k best. The result is that of ``knn_join``.

Pivots and rings only decide how much can be passed over. Vectors for which no
bound holds (another length, no direction, not finite) are in a block of their
own that is always read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.vectors import score_block
from docloom.operators.topk_join import size_of, topk_join
from docloom.operators.vector import VectorScorer, score_lists, vectors_by_length
from docloom.schema import DEFAULT_LIMIT
from docloom.session import shared_dir

PIVOTS, RINGS = 32, 8  # the dictionary has at most PIVOTS * RINGS + 1 rows of 2 * PIVOTS numbers
SAMPLE = 4096  # vectors among which pivots are chosen
FILE_ROWS = 1_000_000  # vectors aimed at per stored file
OTHER = -1  # block of the vectors without bounds
MARGIN = 1e-9  # share of a distance that sums may be off by

VECTORS_DDL = "id string, vector array<float>, away double, block int"
BLOCKS_DDL = "block int, n long, low array<double>, high array<double>"


def _points(lists: pa.Array, dim: int, unit: bool):
    """Rows that bounds hold for, and their places as a matrix; on the unit
    sphere a distance orders as the cosine does."""
    for length, rows, matrix in vectors_by_length(lists):
        if length == dim:
            norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
            good = np.isfinite(norms) & ((norms > 0) | (not unit))
            return rows[good], matrix[good] / (norms[good, None] if unit else 1.0)
    return np.zeros(0, "int64"), np.zeros((0, dim))


def _spread(points: np.ndarray, n: int) -> np.ndarray:
    """Some points far from each other: each next is the farthest from those taken."""
    taken, nearest = [0], -score_block("euclidean", points, points[:1])[:, 0]
    while len(taken) < min(n, len(points)) and nearest.max() > 0:
        taken.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, -score_block("euclidean", points, points[taken[-1:]])[:, 0])
    return points[taken]


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return -score_block("euclidean", points, pivots)


class BlockScorer(VectorScorer):
    """Scores only the pairs whose query asks for the document's block
    (``blocks`` of the queries)."""

    def prepare(self, queries):
        """Each vector once, and per block the numbers of the queries that ask
        for it; their vectors are taken when a block is scored."""
        blocks = queries["blocks"].chunk(0)
        owner = np.repeat(np.arange(len(blocks), dtype="int32"), blocks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        asked = blocks.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(asked, kind="stable")
        found, start = np.unique(asked[order], return_index=True)
        by_block = dict(zip(found.tolist(), np.split(owner[order], start[1:])))
        return by_block, list(vectors_by_length(queries["vector"].chunk(0))), len(blocks)

    def arranged(self, docs):
        return docs.sort_by("block")

    def vectors(self, state):
        return state[1]

    def meetings(self, state, docs):
        block = docs.column("block").to_numpy(zero_copy_only=False)
        for b in np.unique(block).tolist():
            if b in state[0]:
                yield np.flatnonzero(block == b), state[0][b]

    def scores(self, state, docs):
        by_block, vectors, n_queries = state
        out = np.full((docs.num_rows, n_queries), -np.inf)
        block = docs.column("block").to_numpy(zero_copy_only=False)
        for b in np.unique(block).tolist():
            if b in by_block:
                columns = by_block[b]
                place = np.full(n_queries, -1)
                place[columns] = np.arange(len(columns))
                asking = [(place[rows][mine], matrix[mine]) for _, rows, matrix in vectors if (mine := place[rows] >= 0).any()]
                rows = np.flatnonzero(block == b)
                out[np.ix_(rows, columns)] = score_lists(self.metric, docs.column("vector").take(pa.array(rows)), [(m.shape[1], c, m) for c, m in asking])
        return out, None


class VectorIndex:
    """Stored vectors in blocks with bounds, for one metric: ``cosine`` or ``euclidean``.

    Vectors of rows without one (NULL or empty) are not stored.
    """

    def __init__(self, spark: SparkSession, path: str):
        head = spark.read.schema("metric string, dim int, pivots array<array<double>>").parquet(f"{path}/head").first()
        self.spark, self.path, self.metric, self.dim = spark, path, head["metric"], head["dim"]
        self.pivots = np.array(head["pivots"], "float64").reshape(len(head["pivots"]), self.dim)
        rows = spark.read.schema(BLOCKS_DDL).parquet(f"{path}/blocks").orderBy("block").collect()  # PIVOTS * RINGS + 1 at most
        self.blocks, self.n = np.array([r["block"] for r in rows], "int64"), np.array([r["n"] for r in rows], "int64")
        shape = len(rows), len(self.pivots)
        self.low, self.high = (np.array([r[c] for r in rows], "float64").reshape(shape) for c in ("low", "high"))

    @classmethod
    def write(cls, docs: DataFrame, path: str, metric: str = "cosine", pivots: int = PIVOTS, rings: int = RINGS, file_rows: int = FILE_ROWS) -> VectorIndex:
        """Store ``docs(id, vector)`` under a new path.

        The length that most of the sampled vectors have is the one that bounds
        are kept for. Blocks with many vectors are split over files by id, so
        a vector that very many rows share makes no hot task.
        """
        if metric not in ("cosine", "euclidean"):
            raise ValueError(f"no bounds for the metric {metric!r}")
        spark, unit = docs.sparkSession, metric == "cosine"
        rows = docs.where(F.size("vector") > 0).select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
        sample = rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
        groups = [(len(found), length) for length, found, _ in vectors_by_length(sample)] if len(sample) else [(0, 0)]
        dim = int(max(groups)[1])
        points = _points(sample, dim, unit)[1] if dim else np.zeros((0, 0))
        centres = _spread(points, pivots) if len(points) else np.zeros((0, dim))

        def assign(batches):
            for batch in batches:
                good, places = _points(batch.column("vector"), dim, unit)
                pivot, away = np.full(batch.num_rows, OTHER, "int32"), np.zeros(batch.num_rows)
                if len(good) and len(centres):
                    apart = _distances(places, centres)
                    pivot[good], away[good] = apart.argmin(axis=1), apart.min(axis=1)
                yield pa.record_batch({"id": batch.column("id"), "vector": batch.column("vector"), "away": away, "pivot": pivot})

        # stored: distances are computed once, and every pass sees the same rows
        staged = shared_dir(spark, "assigned")
        schema = "id string, vector array<float>, away double, pivot int"
        rows.mapInArrow(assign, schema).write.parquet(staged)
        placed = spark.read.schema(schema).parquet(staged)
        cuts = [i / rings for i in range(1, rings)]
        edges = F.percentile_approx("away", cuts) if cuts else F.array().cast("array<double>")
        edges = {r["pivot"]: r["edges"] for r in placed.where(F.col("pivot") >= 0).groupBy("pivot").agg(edges.alias("edges")).collect()}
        ring = F.lit(0)
        if edges and cuts:
            of_pivot = F.get(F.array(*(F.array(*map(F.lit, edges.get(p) or [0.0])) for p in range(len(centres)))), F.col("pivot"))
            ring = F.size(F.filter(of_pivot, lambda e: e < F.col("away")))
        placed = placed.select("id", "vector", "away", F.when(F.col("pivot") >= 0, F.col("pivot") * rings + ring).otherwise(OTHER).cast("int").alias("block"))
        counts = {r["block"]: r["count"] for r in placed.groupBy("block").count().collect()}
        splits = F.lit(1)
        for b, n in counts.items():
            if n > file_rows:
                splits = F.when(F.col("block") == b, math.ceil(n / file_rows)).otherwise(splits)
        split = F.pmod(F.xxhash64("id"), splits)
        tasks = max(1, sum(math.ceil(n / file_rows) for n in counts.values()))
        placed.repartition(tasks, "block", split).sortWithinPartitions("block", "away", "id").write.partitionBy("block").parquet(f"{path}/vectors")

        def bounds(batches):  # one partial row per block of a task
            low, high, n = {}, {}, {}
            for batch in batches:
                good, places = _points(batch.column("vector"), dim, unit)
                block = batch.column("block").to_numpy(zero_copy_only=False)
                apart = np.zeros((batch.num_rows, len(centres)))
                apart[good] = _distances(places, centres) if len(centres) else 0.0
                for b in np.unique(block):
                    own = apart[block == b]
                    n[b] = n.get(b, 0) + len(own)
                    low[b] = np.minimum(low.get(b, np.inf), own.min(axis=0))
                    high[b] = np.maximum(high.get(b, -np.inf), own.max(axis=0))
            if n:
                keys = sorted(n)
                yield pa.RecordBatch.from_pylist([{"block": b, "n": n[b], "low": list(low[b]), "high": list(high[b])} for b in keys], arrow)

        arrow = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        parts = placed.mapInArrow(bounds, BLOCKS_DDL)
        # element by element: a list's place goes with its value
        each = parts.select("block", "n", F.posexplode_outer(F.arrays_zip("low", "high")))
        each = each.groupBy("block", "pos").agg(F.sum("n").alias("n"), F.min("col.low").alias("low"), F.max("col.high").alias("high"))
        ordered = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "low", "high"))))
        each = each.groupBy("block").agg(F.max("n").alias("n"), ordered.alias("of"))
        each.select("block", "n", F.col("of.low").alias("low"), F.col("of.high").alias("high")).coalesce(1).write.parquet(f"{path}/blocks")
        head = [(metric, dim, [list(map(float, p)) for p in centres])]
        spark.createDataFrame(head, "metric string, dim int, pivots array<array<double>>").coalesce(1).write.parquet(f"{path}/head")
        return cls(spark, path)

    def vectors(self) -> DataFrame:
        """``id, vector, away, block``."""
        return self.spark.read.schema(VECTORS_DDL).parquet(f"{self.path}/vectors")

    def _best_scores(self, lists: pa.Array) -> np.ndarray:
        """The most that a vector of each block can score: ``[queries, blocks]``."""
        best = np.full((len(lists), len(self.blocks)), np.inf)
        good, places = _points(lists, self.dim, self.metric == "cosine")
        bounded = self.blocks != OTHER
        if len(good) and len(self.pivots) and bounded.any():
            apart = _distances(places, self.pivots)[:, :, None]
            low, high = self.low[bounded].T, self.high[bounded].T
            least = np.maximum(apart - high, low - apart).max(axis=1)
            least = np.maximum(least - MARGIN * (1 + apart.max(axis=1) + high.max(axis=0)), 0.0)
            best[np.ix_(good, np.flatnonzero(bounded))] = 1 - least**2 / 2 if self.metric == "cosine" else -least
        return best

    def _with_blocks(self, queries: DataFrame, digits: int | None) -> DataFrame:
        """``query_id, vector, k, blocks, goal``: with ``goal``, a score that
        the k best surely reach, all blocks that can reach it; without, the
        best blocks that together have k vectors. The goal comes out lower by
        what sums may be off."""
        index, slack = self, 0.0 if digits is None else 10.0**-digits

        def choose(batches):
            for batch in batches:
                step = max(1, 4_000_000 // max(1, len(index.blocks) * max(1, len(index.pivots))))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    best, ks = index._best_scores(part.column("vector")), part.column("k").to_numpy(zero_copy_only=False)
                    goals = part.column("goal").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    goals = np.where(np.isfinite(goals), goals - slack - MARGIN * (1 + np.abs(goals)), goals)
                    chosen = []
                    for scores, k, goal, first in zip(best, ks, goals, part.column("first").to_pylist()):
                        if first:
                            order = np.argsort(-scores, kind="stable")
                            need = np.searchsorted(np.cumsum(index.n[order]), k) + 1
                            chosen.append(index.blocks[order[:need]].tolist())
                        else:
                            chosen.append(index.blocks[scores >= goal].tolist())
                    blocks = pa.array(chosen, pa.list_(pa.int32()))
                    yield pa.record_batch([part.column(c) for c in ("query_id", "vector", "k")] + [blocks, pa.array(goals)], names=["query_id", "vector", "k", "blocks", "goal"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", "vector", "k", "goal", "first").mapInArrow(choose, f"query_id {kind}, vector array<float>, k int, blocks array<int>, goal double")

    def _hits(self, asked: DataFrame, digits: int | None, layout: dict) -> DataFrame:
        wanted = [r["block"] for r in asked.select(F.explode("blocks").alias("block")).distinct().collect()]
        docs = self.vectors().where(F.col("block").isin(wanted)).select("id", "vector", "block")  # other directories are not listed
        size = F.size("vector")
        return topk_join(asked, docs, BlockScorer(self.metric), size_of(asked, size + F.size("blocks")), size, digits, **layout).drop("tie")

    def asked(self, queries: DataFrame, k: int = DEFAULT_LIMIT, digits: int | None = None, **layout) -> DataFrame:
        """``query_id, vector, k, blocks, goal``: the blocks that can hold one
        of the k nearest, stored, and a score that these reach. A query without a vector has none."""
        queries = queries.where(F.size("vector") > 0)
        queries = queries if "k" in queries.columns else queries.withColumn("k", F.lit(int(k)))
        queries = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector"), F.col("k").cast("int").alias("k"))
        none = F.lit(None).cast("double")
        first = self._stored(self._with_blocks(queries.select("*", none.alias("goal"), F.lit(True).alias("first")), digits))
        found = self._hits(first, digits, layout).groupBy("query_id").agg(F.min("score").alias("goal"), F.count("*").alias("n"))
        goal = F.when(F.col("n") >= F.col("k"), F.col("goal")).alias("goal")  # fewer than k: every block counts
        second = first.drop("goal").join(found, "query_id", "left").select("query_id", "vector", "k", goal, F.lit(False).alias("first"))
        return self._stored(self._with_blocks(second, digits))

    def knn_join(self, queries: DataFrame, k: int = DEFAULT_LIMIT, digits: int | None = None, **layout) -> DataFrame:
        """The k nearest vectors of every query: ``query_id, id, score, rank``, as ``vector.knn_join`` gives them."""
        return self._hits(self.asked(queries, k, digits, **layout), digits, layout)

    def share(self, asked: DataFrame) -> DataFrame:
        """``query_id, blocks, share``: how many blocks each query of
        :meth:`asked` reads, and the share of all vectors in them."""
        sizes = self.spark.createDataFrame(list(zip(self.blocks.tolist(), self.n.tolist())), "block int, n long")
        read = asked.select("query_id", F.explode("blocks").alias("block")).join(F.broadcast(sizes), "block")
        return read.groupBy("query_id").agg(F.count("*").alias("blocks"), (F.sum("n") / float(self.n.sum())).alias("share"))

    def _stored(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark, "asked")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __getstate__(self):  # travels with the tasks, without its session
        return {name: value for name, value in self.__dict__.items() if name != "spark"}
