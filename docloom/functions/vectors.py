"""Vector functions: metrics between two array columns, blob codec."""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("cosine", "euclidean", "dot")
NEAR_PAIR = 1e-4  # squared distance below this share of the squared norms
NEAR_BLOCK = 100_000  # near pairs computed at a time
WORST_DISTANCE = -sys.float_info.max  # euclidean score of unequal lengths


def metric_name(metric: str) -> str:
    """An unknown metric falls back to cosine."""
    return metric if metric in METRICS else "cosine"


def _inner(a, b) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def dot(a, b) -> Column:
    """Dot product in double precision; 0 for unequal lengths."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    return F.when(F.size(a) == F.size(b), _inner(a, b)).otherwise(F.lit(0.0))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 for unequal lengths or a zero vector."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    norms = F.sqrt(_inner(a, a)) * F.sqrt(_inner(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), _inner(a, b) / norms).otherwise(F.lit(0.0))


def euclidean(a, b) -> Column:
    """Negated distance, so that higher is better for every metric."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
    return F.when(F.size(a) == F.size(b), -distance).otherwise(F.lit(WORST_DISTANCE))


def similarity(metric: str, a, b) -> Column:
    return {"cosine": cosine, "euclidean": euclidean, "dot": dot}[metric_name(metric)](a, b)


def _distances(docs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances as one matrix product.

    The product loses digits where two vectors nearly coincide; those pairs
    are computed again from their differences.
    """
    squares = np.einsum("ij,ij->i", docs, docs)[:, None] + np.einsum("ij,ij->i", queries, queries)
    found = squares - 2 * (docs @ queries.T)
    d, q = np.nonzero(found <= NEAR_PAIR * squares)
    for at in range(0, len(d), NEAR_BLOCK):
        diff = docs[d[at : at + NEAR_BLOCK]] - queries[q[at : at + NEAR_BLOCK]]
        found[d[at : at + NEAR_BLOCK], q[at : at + NEAR_BLOCK]] = np.einsum("ij,ij->i", diff, diff)
    return np.sqrt(found)


def score_block(metric: str, docs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores of every document row against every query row, same length."""
    if metric == "euclidean":
        return -_distances(docs, queries)
    products = docs @ queries.T
    if metric == "dot":
        return products
    norms = np.sqrt(np.einsum("ij,ij->i", docs, docs))[:, None] * np.sqrt(np.einsum("ij,ij->i", queries, queries))
    return np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)


def _variable(kind: pa.DataType, sizes: np.ndarray, values) -> pa.Array:
    """A binary or list column from the sizes of its rows and the values of
    all rows; rows of size 0 are NULL."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
    valid = pa.array(sizes > 0).buffers()[1]
    if pa.types.is_binary(kind):
        return pa.Array.from_buffers(kind, len(sizes), [valid, pa.py_buffer(offsets), pa.py_buffer(values)])
    return pa.Array.from_buffers(kind, len(sizes), [valid, pa.py_buffer(offsets)], children=[pa.array(values, kind.value_type)])


@F.arrow_udf(T.BinaryType())
def vector_to_blob(vectors: pa.Array) -> pa.Array:
    """Float array -> little-endian 32-bit floats; NULL for no vector."""
    lengths = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
    return _variable(pa.binary(), 4 * lengths, values.tobytes())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def blob_to_vector(blobs: pa.Array) -> pa.Array:
    """Inverse of :func:`vector_to_blob`; up to 3 trailing bytes are ignored."""
    lengths = pc.binary_length(blobs).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    data = np.frombuffer(b"".join(x.as_buffer() for x in blobs if x.is_valid), "u1") if lengths.any() else np.zeros(0, "u1")
    whole = lengths // 4 * 4
    if (whole != lengths).any():
        starts = np.cumsum(lengths) - lengths
        data = data[np.repeat(starts - (np.cumsum(whole) - whole), whole) + np.arange(whole.sum())]
    return _variable(pa.list_(pa.float32()), whole // 4, np.frombuffer(data.tobytes(), "<f4"))
