"""Repeated passages: maximal repeats from LCP-interval trees of suffix arrays.

Which suffixes can share ``LEAST`` bytes is decided by content: every window
of LEAST bytes picks the smallest hash among its GRAM-byte strings (a winnowing
minimum) and equal windows pick equal places. A piece is a run of windows with
one pick. Only pieces whose pick occurs elsewhere go on; equal pieces are one
class, counted; classes with one pick are suffix-sorted together.

The sorted suffixes with their common-prefix lengths form a tree of intervals.
A stack scan lists the intervals of at least LEAST bytes, and those whose
occurrences do not all have one left neighbour are maximal repeats, with all
occurrences. Their union covers exactly the bytes of the repeated windows.

A pick with very many classes is cut: into cells of CELL starts grouped by the
bytes that all windows of a cell share, and where that is still too large into
single windows, which are equal or not. So no group grows beyond LIMIT classes.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ODD, binary, chunks, mix, signed, stage

LEAST = 400
GRAM = 128
CELL = 16
LIMIT = 512  # classes sorted together
SORT_BYTES = 1 << 19
LONG = 8 << 20  # longer texts are picked in overlapping parts

_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(77)) * ODD)


def window_hash(data: np.ndarray, width: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Hash of every string of ``width`` bytes, built by doubling."""
    have, out, done = _BYTES[data], None, 0
    power, size = np.uint64(base), 1
    while True:
        if width & size:  # put this block in front of what is done
            if out is None:
                out = have
            else:
                n = len(data) - done - size + 1
                out = have[:n] * np.uint64(pow(base, done, 1 << 64)) + out[size : size + n]
            done += size
        if done == width:
            return mix(out)
        n = len(have) - size
        have = have[:n] * power + have[size:]
        power, size = np.multiply([power], [power])[0], size * 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def picks(data: np.ndarray, offsets: np.ndarray):
    """``(hash, row, place, low, high)``: windows starting at low..high of the
    row all pick the string at place."""
    grams = window_hash(data, GRAM)
    places = np.arange(len(grams), dtype=np.uint64)
    bits = np.uint64(24)
    least = sliding_min((grams >> bits << bits) | places, LEAST - GRAM + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    starts = np.flatnonzero(np.arange(len(least)) + LEAST <= ends)
    if not len(starts):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)
    chosen = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    heads = np.concatenate([[0], np.flatnonzero((np.diff(chosen) != 0) | (np.diff(starts) != 1)) + 1])
    low, high, place = starts[heads], starts[np.append(heads[1:], len(starts)) - 1], chosen[heads]
    row = np.searchsorted(offsets, low, "right") - 1
    return grams[place], row, place - offsets[row], low - offsets[row], high - offsets[row]


def _pick_rows(batches):
    """The picks of each text, of equal texts in one task only once."""
    seen = set()
    for batch, data, offsets in chunks(batches, "text", 1 << 20):
        keys = list(zip(batch.column("c").to_pylist(), batch.column("d").to_pylist()))
        fresh = np.array([not (k in seen or seen.add(k)) for k in keys])
        parts = [(0, data, offsets)]
        if len(data) > LONG:  # one row
            parts = [(at, data[at : at + LONG + LEAST - 1], None) for at in range(0, len(data), LONG)]
        for base, part, cuts in parts:
            if len(part) < LEAST:
                continue
            cuts = np.array([0, len(part)]) if cuts is None else cuts
            found = picks(part, cuts)
            h, row, place, low, high = (x[fresh[found[1]]] for x in found)
            c, d = batch.column("c").take(pa.array(row)), batch.column("d").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([signed(h), c, d, *(pa.array(x + base, pa.int64()) for x in (place, low, high))], ["h", "c", "d", "place", "low", "high"])


_POWERS = np.multiply.accumulate(np.full(4096, np.uint64(0x9FB21C651E98DF25)))


def _fold(values: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix((values * _POWERS[: len(values)]).sum(dtype=np.uint64) + np.uint64(len(values)) * ODD)


def _cut_pieces(batches):
    """The pieces of each text, with their bytes."""
    for batch in batches:
        seen = set()
        for r in range(batch.num_rows):
            key = (batch.column("c")[r].as_py(), batch.column("d")[r].as_py())
            if key in seen:
                continue
            seen.add(key)
            data = np.frombuffer(batch.column("text")[r].as_buffer(), np.uint8)
            runs = batch.column("runs")[r].values
            h, low, high, place = (runs.field(k).to_numpy() for k in ("h", "low", "high", "place"))
            contents = [data[a : b + LEAST].tobytes() for a, b in zip(low, high)]
            # windows at equal distance from their pick are compared: the distance is part of the key
            keys = np.array([_fold(_BYTES[np.frombuffer(x, np.uint8)]) for x in contents], np.uint64) + (place - low).astype(np.uint64) * ODD
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), signed(keys), pa.array([key[0]] * len(h), pa.int64()), pa.array([key[1]] * len(h), pa.int64()), pa.array(low), pa.array(place - low), binary(contents)],
                ["g", "e", "p", "q", "off", "shift", "content"],
            )


_ROWS = "g long, e long, p long, q long, off long, shift long, content binary"


def _cells(batches):
    """Pieces cut into cells of CELL starts on a grid that counts from the
    pick; the group is the bytes that all windows of a full cell share."""
    for batch in batches:
        out = [[] for _ in range(7)]
        for g, e, shift, content in zip(*(batch.column(k).to_pylist() for k in ("g", "e", "shift", "content"))):
            data = np.frombuffer(content, np.uint8)
            n = len(data) - LEAST + 1  # starts 0..n-1, at distance shift - start from the pick
            for cell in range((shift - n + 1) // CELL, shift // CELL + 1):
                low = shift - cell * CELL  # the last start of the full cell
                first, last = max(0, low - CELL + 1), min(n - 1, low)
                core, part = data[low : low - CELL + 1 + LEAST], data[first : last + LEAST]
                group = _fold(_BYTES[core]) ^ mix(np.array([g & ((1 << 64) - 1), cell], np.uint64)).sum(dtype=np.uint64)
                key = _fold(_BYTES[part]) + np.uint64(shift - first) * ODD
                for k, x in enumerate((group, key, g, e, first, shift - first, part.tobytes())):
                    out[k].append(x)
        yield pa.RecordBatch.from_arrays(
            [signed(np.array(out[0], np.uint64)), signed(np.array(out[1], np.uint64)), *(pa.array(x, pa.int64()) for x in out[2:6]), binary(out[6])],
            ["g", "e", "p", "q", "off", "shift", "content"],
        )


def _windows(batches):
    """Every single window, as its own group."""
    for batch in batches:
        g, e, p, q, off = [], [], [], [], []
        for pg, pe, content in zip(*(batch.column(k).to_pylist() for k in ("g", "e", "content"))):
            data = np.frombuffer(content, np.uint8)
            hashes = window_hash(data, LEAST)
            g.append(hashes)
            e.append(window_hash(data, LEAST, 0x9FB21C651E98DF25))
            p.append(np.full(len(hashes), pg))
            q.append(np.full(len(hashes), pe))
            off.append(np.arange(len(hashes)))
        if g:
            n = sum(map(len, g))
            yield pa.RecordBatch.from_arrays(
                [signed(np.concatenate(g)), signed(np.concatenate(e)), *(pa.array(np.concatenate(x), pa.int64()) for x in (p, q, off)), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())],
                ["g", "e", "p", "q", "off", "shift", "content"],
            )


def suffix_ranks(codes: np.ndarray, base: int, depth: int) -> list[tuple[int, np.ndarray]]:
    """``(length, rank)`` by doubling: rank of each place by its next ``length``
    codes. Codes are under ``base``; the last one is unique."""
    n = len(codes)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([codes, np.zeros(3, np.int64)])
    for k in range(4):
        key = key * base + padded[k : k + n]
    levels, length = [], 4
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        levels.append((length, rank))
        if length >= depth:
            return levels
        key = rank * n
        key[: n - length] += rank[length:]
        length *= 2


def maximal_repeats(pieces: list[bytes], least: int = LEAST):
    """Maximal repeats of at least ``least`` bytes among the pieces.

    Yields ``(length, places)``; places index the pieces put one after
    another with one separator after each. Returns through ``places`` all
    occurrences of the repeat, also overlapping ones.
    """
    sizes = np.array([len(x) for x in pieces])
    ends = np.cumsum(sizes + 1) - 1
    n, count = int(ends[-1]) + 1, len(pieces)
    codes = np.empty(n, np.int64)
    inside = np.ones(n, bool)
    inside[ends] = False
    codes[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + count
    codes[ends] = np.arange(count)
    levels = suffix_ranks(codes, 256 + count, int(sizes.max()) + 1)
    rest = np.repeat(ends, sizes + 1) - np.arange(n)
    valid = np.flatnonzero(rest >= least)
    if len(valid) < 2:
        return
    suffixes = valid[np.argsort(levels[-1][1][valid], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(len(a), np.int64)
    for length, rank in reversed(levels):
        x, y = a + common, b + common
        fits = (x < n) & (y < n)
        common += length * (fits & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]))
    for _ in range(3):
        x, y = a + common, b + common
        common += (x < n) & (y < n) & (codes[np.minimum(x, n - 1)] == codes[np.minimum(y, n - 1)])
    left = np.where(suffixes > 0, codes[suffixes - 1], -1)
    changes = np.maximum.accumulate(np.where(np.concatenate([[False], left[1:] != left[:-1]]), np.arange(len(left)), 0))
    joined = np.concatenate([[False], common >= least, [False]])
    heads, tails = np.flatnonzero(~joined[:-1] & joined[1:]), np.flatnonzero(joined[:-1] & ~joined[1:])
    varied = changes[tails] > heads
    for head, tail in zip(heads[varied].tolist(), tails[varied].tolist()):
        stack: list[tuple[int, int]] = []
        for at, length in enumerate([*common[head:tail].tolist(), 0], head):
            begin = at
            while stack and stack[-1][0] > length:
                top, begin = stack.pop()
                if changes[at] > begin:
                    yield top, suffixes[begin : at + 1]
            if length and (not stack or stack[-1][0] < length):
                stack.append((length, begin))


def _covered(pieces: list[bytes]):
    """``(piece, low, high)`` of the bytes in maximal repeats."""
    sizes = np.array([len(x) + 1 for x in pieces])
    ends = np.cumsum(sizes)
    edge = np.zeros(int(ends[-1]) + 1, np.int64)
    for length, places in maximal_repeats(pieces):
        edge[places] += 1  # places are distinct, their ends too
        edge[places + length] -= 1
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    low, high = np.flatnonzero(~covered[:-1] & covered[1:]), np.flatnonzero(covered[:-1] & ~covered[1:])
    piece = np.searchsorted(ends, low, "right")
    base = ends[piece] - sizes[piece]
    return piece, low - base, high - base


def _sort_groups(batches):
    """Rows come sorted by group; groups are sorted together in lots."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush(rows):
        found = []
        piece, low, high = _covered([x[2] for x in rows])
        found = [pa.array([rows[i][0] for i in piece], pa.int64()), pa.array([rows[i][1] for i in piece], pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
        return pa.RecordBatch.from_arrays(found, ["g", "e", "low", "high"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("g", "e", "content"))):
            if size >= SORT_BYTES and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2])
    if held:
        yield flush(held)


def _repeats(rows: DataFrame, level: int = 0) -> DataFrame:
    """``(p, q, low, high)``: repeated bytes of the parents of these pieces."""
    counts = stage(rows.groupBy("g", "e").agg(F.count("*").alias("m"), F.min(F.struct("p", "q", "off")).alias("one")), f"classes{level}")
    groups = stage(counts.groupBy("g").agg(F.count("*").alias("classes")).where("classes > 1"), f"groups{level}")
    whole = counts.where("m > 1").select("g", "e", F.lit(0).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    found = whole
    if level < 2:
        mixed = counts.join(groups, "g").select("g", "e", "one.*", "classes")
        contents = stage(rows.join(mixed, ["g", "e", "p", "q", "off"]), f"contents{level}")
        few = contents.where(F.col("classes") <= LIMIT).select("g", "e", "content")
        # sorting takes much time per byte: more and smaller tasks than Spark would make by size
        tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = found.union(few.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(_sort_groups, "g long, e long, low long, high long"))
        if groups.where(F.col("classes") > LIMIT).head(1):
            many = contents.where(F.col("classes") > LIMIT).select("g", "e", "shift", "content")
            finer = stage(many.mapInArrow(_windows if level else _cells, _ROWS), f"finer{level}")
            found = found.union(_repeats(finer, level + 1).select(F.col("p").alias("g"), F.col("q").alias("e"), "low", "high"))
    members = rows.select("g", "e", "p", "q", "off", F.coalesce(F.octet_length("content"), F.lit(LEAST)).alias("size"))
    parts = members.join(found, ["g", "e"])
    return stage(parts.select("p", "q", (F.col("off") + F.col("low")).alias("low"), (F.col("off") + F.coalesce("high", "size")).alias("high")), f"covered{level}")


def _remove(batches, with_bytes=True):
    """Cut the covered bytes out of each text."""
    for batch in batches:
        out = [[], [], [], [], []]
        for r in range(batch.num_rows):
            text = batch.column("text")[r]
            data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
            runs = batch.column("runs")[r]
            spans, kept = 0, data
            if runs.is_valid and len(runs.values):
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, np.minimum(runs.values.field("low").to_numpy(), len(data)), 1)
                np.add.at(edge, np.minimum(runs.values.field("high").to_numpy(), len(data)), -1)
                covered = np.cumsum(edge[:-1]) > 0
                spans = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()) if len(data) else 0
                kept = data[~covered]
            kept = kept.tobytes()
            for k, x in enumerate((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None)):
                out[k].append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3]), binary(out[4])],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"],
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes)`` per row.

    A byte goes if it lies in a string of ``LEAST`` bytes that also starts
    elsewhere: in another row, or at another place of the same row, overlaps
    included. All strings are judged on the input. Null and empty texts have
    no bytes. Rows with one id are separate rows, an id may be null, and two
    rows with equal texts repeat each other. kept_bytes need not be valid
    UTF-8. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("id", "text", F.xxhash64("text").alias("c"), F.hash("text").cast("long").alias("d"))
    long = docs.where(F.octet_length("text") >= LEAST)
    runs = stage(long.mapInArrow(_pick_rows, "h long, c long, d long, place long, low long, high long"), "picks")
    spot = F.xxhash64("c", "d", "place")
    again = stage(runs.groupBy("h").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first <> last").select("h"), "again")
    # both sides of the join are stored and its result is dealt anew, so that Spark can split it at a common pick
    shared = runs.join(again, "h", "left_semi").repartition("c", "d").distinct()
    per_text = shared.groupBy("c", "d").agg(F.collect_list(F.struct("h", "place", "low", "high")).alias("runs"))
    copies = long.groupBy("c", "d").agg(F.min(F.coalesce("id", F.lit(-1))).alias("one"), F.count("*").alias("m"), F.first(F.octet_length("text")).cast("long").alias("size"))
    copies = stage(copies, "copies")
    chosen = per_text.join(copies.select("c", "d", "one"), ["c", "d"])
    texts = long.withColumn("one", F.coalesce("id", F.lit(-1))).join(chosen, ["c", "d", "one"]).select("c", "d", "text", "runs")
    pieces = stage(texts.mapInArrow(_cut_pieces, _ROWS), "pieces")
    covered = _repeats(pieces)
    equal = copies.where("m > 1").select(F.col("c").alias("p"), F.col("d").alias("q"), F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))
    spans = covered.join(equal, ["p", "q"], "left_anti").union(equal).groupBy("p", "q").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    spans = stage(spans, "spans")  # read plainly, so that Spark can split the join at a text of many copies
    rows = docs.join(spans, (F.col("c") == F.col("p")) & (F.col("d") == F.col("q")), "left").select("id", "text", "runs")
    out = rows.mapInArrow(partial(_remove, with_bytes=with_bytes), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return out.withColumnRenamed("id", id_col)
