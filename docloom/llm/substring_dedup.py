"""Repeated word windows, counted exactly in super-k-mer buckets.

A window is WORDS words in a row. Its minimiser is the GRAM-word string with
the least hash (the leftmost of equal ones); it depends on the window's words
alone, so equal windows have equal minimisers. Neighbouring windows that share
one are a super-k-mer: one packed string of at most 2 * WORDS - GRAM words in
place of as many windows, sent to the bucket of its minimiser. There the
windows are cut out again and sorted, and equal ones meet.

Only super-k-mers whose minimiser occurs more than once are packed and sent.
Equal texts are one class from the start, and equal packed strings are
one class of their bucket, so copies cost partial aggregates and no more. A
bucket with over LIMIT different strings is not sorted by one task: its
windows are dealt one by one, by their digest.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import CHUNK_BYTES, ODD, byte_table, chunks, gram_hashes, signed, stage, stage_at, word_hashes
from docloom.llm.suffix_dedup import sliding_min
from docloom.session import remove_dir, shared_dir

WORDS = 13
GRAM = 5
LIMIT = 2048  # different strings of a bucket that one task sorts
_PLACE = np.uint64(24)  # bits of a place inside a chunk
_BLOCK = 1 << 20  # words of a long text looked at together

_SEPARATORS = [32, *range(9, 14)]
_TABLE = byte_table(_SEPARATORS, fold_case=False)
_INSIDE = _TABLE != 0


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """``(starts, lengths, first)``: bytes of every word; words of row r are ``first[r]:first[r + 1]``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _INSIDE[data]
    edge = inside[1:] != inside[:-1]
    cuts = offsets[1:-1][inside[offsets[1:-1]] & inside[offsets[1:-1] + 1]] if len(data) else offsets[:0]  # two rows' words touch
    at = np.sort(np.concatenate([np.flatnonzero(edge), np.repeat(np.unique(cuts), 2)]))
    starts = at[0::2]
    return starts, at[1::2] - starts, np.searchsorted(starts, offsets)


def packed_words(data: np.ndarray, offsets: np.ndarray):
    """``(packed, place, first)``: all words, each followed by one space;
    word i begins at ``place[i]`` and ``place`` ends with the total length."""
    starts, lengths, first = word_bounds(data, offsets)
    place = np.concatenate([[0], np.cumsum(lengths + 1)])
    packed = np.full(int(place[-1]), 32, np.uint8)
    source = _INSIDE[data]
    packed[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = data[source]
    return packed, place, first


def super_kmers(words: np.ndarray, first: np.ndarray):
    """``(hash, row, at, size)``: ``size`` windows from word ``at`` of the row on share a minimiser with this hash."""
    grams = gram_hashes(words, GRAM)
    none = np.zeros(0, np.int64)
    if len(words) < WORDS:
        return np.zeros(0, np.uint64), none, none, none
    places = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams >> _PLACE << _PLACE) | places, WORDS - GRAM + 1)
    ends = np.repeat(first[1:], np.diff(first))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + WORDS <= ends)
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    chosen = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    heads = np.concatenate([[0], np.flatnonzero((np.diff(chosen) != 0) | (np.diff(starts) != 1)) + 1])
    row = np.searchsorted(first, starts[heads], "right") - 1
    return grams[chosen[heads]], row, starts[heads] - first[row], np.diff(np.append(heads, len(starts)))


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, taken part by part."""
    out, at = [], 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        while end < len(data) and _INSIDE[data[end]]:  # no word is cut
            step = np.flatnonzero(~_INSIDE[data[end : end + CHUNK_BYTES]])
            end += int(step[0]) if len(step) else min(CHUNK_BYTES, len(data) - end)
        out.append(word_hashes(data[at:end], np.array([0, end - at]), _TABLE)[2])
        at = end
    return np.concatenate(out)


def _parts(data: np.ndarray, offsets: np.ndarray):
    """``(base, words, first)``: the words of a chunk, or of one long text block by block with the windows across."""
    if len(data) <= 2 * CHUNK_BYTES:
        _, _, words, first = word_hashes(data, offsets, _TABLE)
        yield 0, words, first
        return
    words = _long_words(data)
    for at in range(0, max(1, len(words) - WORDS + 1), _BLOCK):
        part = words[at : at + _BLOCK + WORDS - 1]
        yield at, part, np.array([0, len(part)])


def _minimisers(batches):
    """The minimisers of each text's super-k-mers."""
    for batch, data, offsets in chunks(batches, "text"):
        for _, words, first in _parts(data, offsets):
            g, row, _, _ = super_kmers(words, first)
            yield pa.RecordBatch.from_arrays([signed(g), batch.column("no").take(pa.array(row))], ["g", "no"])


def _pack(batches):
    """The super-k-mers of each text with one of the listed minimisers, as packed strings."""
    for batch, data, offsets in chunks(batches, "text"):
        packed, place, begin = packed_words(data, offsets)
        packed = packed.tobytes()
        listed = batch.column("listed")
        counts = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        wanted = listed.flatten().to_numpy().view(np.uint64) + np.repeat(np.arange(len(counts), dtype=np.uint64), counts) * ODD
        for base, words, first in _parts(data, offsets):
            g, row, at, size = super_kmers(words, first)
            chosen = np.isin(g + row.astype(np.uint64) * ODD, wanted)
            g, row, at, size = g[chosen], row[chosen], at[chosen] + base, size[chosen]
            low = place[begin[row] + at].tolist()
            high = (place[begin[row] + at + size + WORDS - 1] - 1).tolist()
            content = pa.array([packed[a:b] for a, b in zip(low, high)], pa.binary())
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([signed(g), batch.column("no").take(row), batch.column("first").take(row), pa.array(at.astype(np.int32)), content], ["g", "no", "first", "at", "content"])


def sort_windows(contents: list[bytes], low: list[int]) -> list[list[int]]:
    """For every window of every packed string, the least ``low`` of the strings that hold it."""
    words = [x.split(b" ") for x in contents]
    least = [[low[i]] * (len(w) - WORDS + 1) for i, w in enumerate(words)]
    if len(contents) > 1:
        windows = sorted((b" ".join(w[j : j + WORDS]), low[i], i, j) for i, w in enumerate(words) for j in range(len(w) - WORDS + 1))
        current, smallest = None, None
        for window, own, i, j in windows:  # equal windows are neighbours, the least first
            if window != current:
                current, smallest = window, own
            least[i][j] = smallest
    return least


def _buckets(batches):
    """Sort the windows of each bucket; rows come sorted by bucket, and at most LIMIT rows have one.

    Gives the strings some of whose windows also start in a smaller document.
    """
    held, bucket = [], None

    def settle(rows):
        if not rows or min(r[2] for r in rows) >= max(r[3] for r in rows):
            return  # one document only
        for (g, e, _, high, _), least in zip(rows, sort_windows([r[4] for r in rows], [r[2] for r in rows])):
            hits = [{"j": j, "least": x} for j, x in enumerate(least) if x < high]
            if hits:
                yield g, e, hits

    def out(found):
        g, e, hits = zip(*found)
        hit = pa.list_(pa.struct([("j", pa.int32()), ("least", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(e, pa.int64()), pa.array(hits, hit)], ["g", "e", "hits"])

    for batch in batches:
        found = []
        for row in zip(*(batch.column(k).to_pylist() for k in ("g", "e", "low", "high", "content"))):
            if row[0] != bucket:
                found.extend(settle(held))
                held, bucket = [], row[0]
            held.append(row)
        if found:
            yield out(found)
    if found := list(settle(held)):
        yield out(found)


def _dealt_windows(classes: DataFrame) -> DataFrame:
    """The same for buckets of any size: every window is a row of its own."""
    word = F.split(F.col("content").cast("string"), " ")
    window = lambda j: F.unhex(F.md5(F.array_join(F.slice("words", j + 1, WORDS), " ").cast("binary")))
    rows = classes.select("g", "e", "low", "high", word.alias("words"))
    rows = rows.select("g", "e", "low", "high", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - WORDS), window)).alias("j", "w"))
    rows = stage(rows, "windows")
    least = stage(rows.groupBy("w").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("w", "least"), "least")
    hits = rows.join(least, "w").where("least < high")
    return hits.groupBy("g", "e").agg(F.collect_list(F.struct("j", "least")).alias("hits"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(c, d, first, runs)``: of each class of equal texts in
    ``docs(id, text, c, d)`` the smallest id, and the lists of starts of its
    windows that also start in a text with a smaller one. Classes of one row
    without such a window are left out."""
    docs = docs.where(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * WORDS - 1))
    copies = stage(docs.groupBy("c", "d").agg(F.min("id").alias("first"), F.max("id").alias("last")), "copies")
    # of equal texts one is looked at; its number is small and compresses well wherever it is shuffled
    texts = docs.withColumnRenamed("id", "first").join(copies.select("c", "d", "first"), ["c", "d", "first"])
    texts = stage(texts.withColumn("no", F.monotonically_increasing_id()), "texts")
    spark = docs.sparkSession
    scratch = shared_dir(spark, "minimisers")  # the longest of the working tables
    kmers = stage_at(texts.select("no", "text").mapInArrow(_minimisers, "g long, no long"), scratch)
    # what the join looks up is stored, so that Spark can split it at a common minimiser
    again = stage(kmers.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "again")
    listed = stage(kmers.join(again, "g", "left_semi").groupBy("no").agg(F.collect_set("g").alias("listed")), "listed")
    remove_dir(spark, scratch)
    chosen = texts.select("no", "first", "text").join(listed, "no")
    pieces = stage(chosen.mapInArrow(_pack, "g long, no long, first long, at int, content binary").withColumn("e", F.xxhash64("content")), "pieces")

    classes = stage(pieces.groupBy("g", "content").agg(F.min("first").alias("low"), F.max("first").alias("high")).withColumn("e", F.xxhash64("content")), "strings")
    large = stage(classes.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > LIMIT).select("g"), "large")
    hits = "g long, e long, hits array<struct<j: int, least: long>>"
    some = large.head(1)
    few = classes.join(large, "g", "left_anti") if some else classes
    found = few.select("g", "e", "low", "high", "content").repartition("g").sortWithinPartitions("g").mapInArrow(_buckets, hits)
    if some:
        found = found.union(_dealt_windows(classes.join(large, "g", "left_semi")))
    found = stage(found, "hits")
    starts = F.transform(F.filter("hits", lambda x: x["least"] < F.col("first")), lambda x: F.col("at") + x["j"])
    runs = pieces.select("g", "e", "no", "first", "at").join(found, ["g", "e"]).select("no", starts.alias("starts")).where(F.size("starts") > 0)
    runs = texts.select("no", "c", "d").join(runs, "no").groupBy("c", "d").agg(F.collect_list("starts").alias("runs"))
    judged = copies.join(runs, ["c", "d"], "left").where("first <> last OR runs IS NOT NULL")
    return stage(judged.select("c", "d", "first", "runs"), "judged")  # read plainly, so that Spark can split the join at a text of many copies


def _remove(batches, with_text=True):
    """Cut the covered words out of each text."""
    for batch, data, offsets in chunks(batches, "text"):
        packed, place, first = packed_words(data, offsets)
        n_words, n_removed, kept = np.diff(first), np.zeros(batch.num_rows, np.int64), []
        for r, (id, smallest, runs) in enumerate(zip(batch.column("id").to_pylist(), batch.column("first").to_pylist(), batch.column("runs"))):
            a, b = place[first[r]], place[first[r + 1]]
            own = packed[a:b]
            if id is not None and smallest is not None and n_words[r] >= WORDS:
                if id > smallest:  # the whole text stands in a smaller document
                    own = own[:0]
                    n_removed[r] = n_words[r]
                elif id == smallest and runs.is_valid:
                    edge = np.zeros(n_words[r] + 1, np.int64)
                    starts = runs.values.flatten().to_numpy()
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + WORDS, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    own = own[np.repeat(stays, np.diff(place[first[r] : first[r + 1] + 1]))]
                    n_removed[r] = n_words[r] - stays.sum()
            kept.append(own[:-1].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept if with_text else [None] * len(kept), pa.binary())],
            ["id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, kept_text)`` per row of ``docs``.

    Words are runs of bytes without ASCII white space, unchanged. A word goes
    if it lies in a window of WORDS words that also starts in a row with a
    smaller id; all windows are judged on the input. ``kept_text`` joins the
    other words by one space.

    A null, empty or blank text has no words; a text of fewer than WORDS words
    has no window. Rows with one id do not cut each other, each is cut by
    rows of smaller ids. A row without an id is smaller and greater than none:
    it stays whole and cuts nothing. Ids are whole numbers. Other columns are
    ignored, whatever their names. An empty table gives none.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("id", "text", F.xxhash64("text").alias("c"), F.hash("text").cast("long").alias("d"))
    judged = repeated_windows(docs).select(F.col("c").alias("jc"), F.col("d").alias("jd"), "first", "runs")
    rows = docs.join(judged, (F.col("c") == F.col("jc")) & (F.col("d") == F.col("jd")), "left").select("id", "text", "first", "runs")
    out = rows.mapInArrow(partial(_remove, with_text=with_text), "id long, n_words long, n_removed long, kept_sha256 string, kept_text binary")
    return out.withColumn("kept_text", F.col("kept_text").cast("string")).withColumnRenamed("id", id_col)
