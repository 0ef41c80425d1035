"""Filling in vectors: pluggable embedders and the backfill of pending rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Length and filler of the placeholder embedding, documents
# embedded per cycle where a rate is asked for.
STUB_DIM = 2560
STUB_VALUE = 0.1
CYCLE_SIZE = 15

BROADCAST_ROWS = 100_000


class StubEmbedder:
    """Placeholder: the same constant vector for every text."""

    def __init__(self, dim: int = STUB_DIM):
        self.dim = dim

    def column(self, text) -> Column:
        filler = F.array_repeat(F.lit(STUB_VALUE).cast("float"), self.dim)
        return F.struct(filler.alias("vector"), F.lit(None).cast("string").alias("error"))


class BatchEmbedder:
    """Runs ``fn(list of texts) -> one vector per text`` on Arrow batches.

    A failing batch is retried text by text. A text that fails, or whose
    vector has the wrong length, fails the job (``on_error="fail"``) or gets
    a NULL vector and an error message (``"null"``).
    """

    def __init__(self, fn: Callable, dim: int, on_error="fail"):
        self.fn, self.dim, self.on_error = fn, dim, on_error

    def column(self, text) -> Column:
        fn, dim, on_error = self.fn, self.dim, self.on_error

        def checked(vectors):
            vectors = [np.asarray(v, "float32") for v in vectors]
            if any(v.shape != (dim,) for v in vectors):
                raise ValueError(f"dimension is not {dim}")
            return vectors

        def one(content):
            try:
                return checked(fn([content]))[0], None
            except Exception as error:
                return None, str(error)

        @F.pandas_udf("vector array<float>, error string")
        def embed(texts: pd.Series) -> pd.DataFrame:
            contents = texts.tolist()
            try:
                vectors = checked(fn(contents)) if contents else []
                if len(vectors) != len(contents):
                    raise ValueError("one vector per text expected")
                rows = [(v, None) for v in vectors]
            except Exception:
                if on_error == "fail":
                    raise
                rows = [one(c) for c in contents]
            return pd.DataFrame(rows, columns=["vector", "error"])

        # an expensive call: keep the optimizer from repeating it in filters
        return embed.asNondeterministic()(text)


def embed_column(df: DataFrame, embedder, text="content", vector="vector", error=None) -> DataFrame:
    """Add the embedding of a text column, and the error column if named."""
    df = df.withColumn("_embedded", embedder.column(F.col(text)))
    df = df.withColumn(vector, F.col("_embedded.vector"))
    return (df.withColumn(error, F.col("_embedded.error")) if error else df).drop("_embedded")


def backfill_cycle(docs: DataFrame, embedder, n: int | None = None, failures: DataFrame | None = None, max_tries: int | None = None) -> DataFrame:
    """Vectors for the next pending documents of several collections.

    ``docs`` carries ``db`` and ``table``. All pending documents are done,
    or, with a rate ``n``, the n oldest of each table, and of those that
    succeed the first n overall: ``db, table, id, vector``. The others stay
    pending. ``failures(db, table, id, tries)`` counts earlier tries: with
    ``max_tries`` a document that failed as often is passed over, so it
    cannot keep those behind it waiting.
    """
    done = attempted(docs, embedder, n, failures, max_tries).where(F.col("vector").isNotNull())
    if n is not None:
        done = done.orderBy("db", "table", "created_at", "id").limit(n)
    return done.select("db", "table", "id", "vector")


def attempted(docs: DataFrame, embedder, n: int | None = None, failures: DataFrame | None = None, max_tries: int | None = None) -> DataFrame:
    """The pending documents of a cycle with ``vector`` and ``error``."""
    keys = ["db", "table", "id", *(["bucket"] if "bucket" in docs.columns else [])]
    queue = docs.where(~F.col("is_embedded"))
    if failures is not None and max_tries is not None:
        given_up = failures.where(F.col("tries") >= max_tries).select("db", "table", "id").distinct()
        queue = queue.join(given_up, ["db", "table", "id"], "left_anti")
    if n is not None:
        # ranked without the texts; the texts of the chosen few are fetched
        # by broadcast, and their buckets prune the directories to read
        oldest = W.partitionBy("db", "table").orderBy("created_at", "id")
        place = F.row_number().over(oldest).alias("place")
        chosen = queue.select(*keys, "created_at", place).where(F.col("place") <= n).drop("place", "created_at")
        n_chosen = n * docs.select("db", "table").distinct().count()
        queue = queue.join(F.broadcast(chosen) if n_chosen <= BROADCAST_ROWS else chosen, keys)
    queue = queue.select("db", "table", "id", "content", "created_at")
    return embed_column(queue, embedder, error="error")
