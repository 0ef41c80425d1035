"""Embedding whitening with MLlib's distributed block matrices.

Every entry becomes a whole number, so sums and distances from the mean are
exact. The centred rows get an index and become the blocks of a BlockMatrix;
its transpose times itself is the scatter matrix, summed over splits of the
row blocks, so that no task meets all rows. That matrix has the size of the
dimensions only and is decomposed on the driver; the BlockMatrix times the
whitening matrix projects the rows.
"""

from __future__ import annotations

from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK_BYTES = 2 << 20
LARGEST = float(1 << 40)  # entries beyond are taken as this


def whole_vectors(column: pa.Array, dim: int):
    """``(rows, x)``: the rows whose vector has ``dim`` finite entries, as whole numbers."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    entries = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    finite = np.isfinite(entries).all(axis=1)
    return rows[finite], np.floor(SCALE * np.clip(entries[finite], -LARGEST, LARGEST)).astype(np.int64) + SHIFT


def _clean(batches, dim):
    for batch in batches:
        rows, x = whole_vectors(batch.column("vector"), dim)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), _lists(x)], ["id", "x"])


def _lists(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(batches, dim):
    """Column sums of a task's rows, as one row."""
    total = np.zeros(dim, np.int64)
    for batch in batches:
        total += _matrix(batch.column("x"), dim).sum(axis=0)
    yield pa.RecordBatch.from_arrays([_lists(total[None, :])], ["sums"])


def square_sums(y: np.ndarray) -> list[int]:
    """Exact sums of squares of each row of whole numbers below 2**52: they may pass 64 bits."""
    high, low = y >> 24, y & ((1 << 24) - 1)
    sums = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return [(a << 48) + (b << 25) + c for a, b, c in zip(*(s.tolist() for s in sums))]


def _centre(batches, n, sums):
    sums = np.array(sums, np.int64)
    for batch in batches:
        y = n * _matrix(batch.column("x"), len(sums)) - sums
        deviation = pa.array([Decimal(d) for d in square_sums(y)], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([batch.column("index"), batch.column("id"), deviation, _lists(y / n)], ["index", "id", "deviation", "centred"])


def _products(batches, width):
    """Count, sums and sums of products of a task's rows, as one row."""
    total = np.zeros((width + 1, width + 1))
    for batch in batches:
        rows = _matrix(batch.column("whitened"), width)
        rows = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
        total += rows.T @ rows
    yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1))], ["sums"])


def _added(parts: DataFrame) -> list:
    """Entry by entry sums of ``sums``; as many values as one row has."""
    added = parts.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    return [r["value"] for r in added.orderBy("at").collect()]


def _indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``index`` counting from 0: the place in its partition,
    after all rows of earlier partitions. One row per partition is counted."""
    placed = stage(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "vectors")
    counts = placed.groupBy("part").agg(F.count("*").alias("m"))
    before = counts.select("part", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    return placed.join(before, "part").withColumn("index", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """Transpose times itself. The row blocks are summed in splits: left
    whole, MLlib would bring all of them to the one task of the result."""
    n_blocks = -(-blocks.numRows() // blocks.rowsPerBlock)
    splits = max(1, min(-(-n_blocks // 8), 4096))
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, at most
    ``most``. Those that are zero but for rounding are left out; the largest
    entry of a vector is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    real = values > max(values[0], 0) * len(covariance) * np.finfo(float).eps
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return values, vectors
    return values, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """``(id, n, deviation, whitened, explained, identity_error)`` per vector.

    ``whitened`` lists the vector's projections on the ``most`` largest
    components, each over the root of its eigenvalue; ``explained`` the
    components' shares of the whole variance. ``deviation`` is the exact sum of
    squares of n * x - S. ``identity_error`` is the largest entry of the
    whitened rows' measured covariance minus the identity.

    A null vector, one with a null or non-finite entry, and one whose length
    is not the commonest (of equally common ones the greatest) is left out.
    Entries are clipped at 2**40. Null and repeated ids are rows like others.
    Components without variance are left out, so a single row or equal rows
    give none and no result, as does an empty table. Other columns are ignored.
    """
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    none = spark.createDataFrame([], f"{id_col} {id_type}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    lengths = rows.where("vector IS NOT NULL").groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("m"))
    commonest = lengths.orderBy(F.desc("m"), F.desc("dim")).first()
    dim = commonest["dim"] if commonest else 0
    if not dim:
        return none
    whole = stage(_indexed(rows.mapInArrow(partial(_clean, dim=dim), f"id {id_type}, x array<long>")), "whole")
    n = whole.count()
    if not n:
        return none
    sums = _added(whole.select("x").mapInArrow(partial(_sums, dim=dim), "sums array<long>"))
    centred = whole.select("index", "id", "x").mapInArrow(partial(_centre, n=n, sums=sums), f"index long, id {id_type}, deviation decimal(38,0), centred array<double>")
    centred = stage(centred, "centred")

    indexed = MLUtils.convertVectorColumnsFromML(centred.select("index", array_to_vector("centred").alias("vector")), "vector")
    rows_per_block = max(64, min(8192, BLOCK_BYTES // (8 * dim)))
    blocks = IndexedRowMatrix(indexed, n, dim).toBlockMatrix(rows_per_block, dim)
    covariance = scatter(blocks) / n
    values, directions = components(covariance, most)
    width = len(values)
    if not width:
        return none
    matrix = Matrices.dense(dim, width, (directions / np.sqrt(values)).T.reshape(-1).tolist())
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), matrix)], 1), dim, width, dim, width)
    projected = blocks.multiply(whitening).toIndexedRowMatrix()
    found = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).toDF("index", "vector"), "vector")
    found = stage(found.select("index", vector_to_array("vector").alias("whitened")), "whitened")

    products = np.array(_added(found.select("whitened").mapInArrow(partial(_products, width=width), "sums array<double>"))).reshape(width + 1, width + 1)
    mean = products[:-1, -1] / products[-1, -1]
    error = float(np.abs(products[:-1, :-1] / products[-1, -1] - np.outer(mean, mean) - np.eye(width)).max())
    explained = F.array(*(F.lit(float(v / np.trace(covariance))) for v in values))
    out = centred.select("index", "id", "deviation").join(found, "index")
    return out.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
