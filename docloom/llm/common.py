"""Helpers that the operators of this subpackage share.

Text work runs on the UTF-8 bytes of an Arrow column: the functions take the
value buffer and the row offsets and work on all rows of a chunk at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import shared_dir

CHUNK_BYTES = 4 << 20  # text of one numpy pass; a longer document is one pass of its own
ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write to a new shared folder and read back: lineage ends here, and a
    lost executor costs its running tasks only."""
    return stage_at(df, shared_dir(df.sparkSession, label), codec)


def stage_at(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """As ``stage`` in a folder that the caller knows, and so can remove."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def column(name: str) -> Column:
    """The column of exactly this name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(id_col: str = "doc_id"):
    """One row in five, by the checksum of its id, is never trained on."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(id, label)`` to learn from: ids that are not held out and have one
    label, 0 or 1. A null id, or one with labels that differ, gives none."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    return rows.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, text, label, nth)`` of ``docs(id, text)`` with a label to learn
    from, stored with a number per row, since training reads it more than once. Labels grow with the
    documents, so they are merged, not broadcast, at every size."""
    rows = docs.where(F.col("id").isNotNull() & ~held_out("id")).join(labels.hint("merge"), "id")
    return stage(rows.withColumn("nth", F.monotonically_increasing_id()), "labelled")


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(separators, fold_case: bool = True) -> np.ndarray:
    """Random 64-bit value per byte, 0 for separators; capitals A-Z as a-z."""
    table = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * ODD)
    if fold_case:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


#: Words between ASCII white space, and words of letters, digits and non-ASCII characters.
SPACE_TABLE = byte_table([32, *range(9, 14)])
ALNUM_TABLE = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    if column.null_count and len(data):  # Arrow allows bytes under a null
        gone = np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False))
        if (offsets[gone + 1] > offsets[gone]).any():
            return buffers(column.fill_null("" if pa.types.is_large_string(column.type) else b""))
    return data, offsets


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` bytes of text, with bytes and offsets."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """``(starts, ends, hashes, first)``: byte range and 64-bit hash of every
    word; words of row r are ``first[r]:first[r + 1]``. No word crosses rows."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    values = table[data]
    inside = values != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    stops[tails] = inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), first
    nth = np.arange(n, dtype=np.int64)
    nth -= np.repeat(starts, np.diff(np.append(starts, n)))[: n - starts[0]] if starts[0] == 0 else np.concatenate(
        [np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, n)))]
    )
    longest = int((ends - starts).max())
    powers = np.full(longest + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values *= powers[np.minimum(nth, longest)]
    hashes = np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64) * ODD
    return starts, ends, mix(hashes), first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total *= _BASE
        total += words[k : len(words) - n + 1 + k]
    return mix(total)


def binary(rows: list[bytes | None] | None = None, data: np.ndarray | None = None, offsets: np.ndarray | None = None) -> pa.Array:
    """A binary column from byte strings, or from one buffer and offsets."""
    if rows is not None:
        return pa.array(rows, pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))
