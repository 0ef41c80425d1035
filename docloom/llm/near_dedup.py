"""Near-duplicate documents: a multi-index Hamming join over MinHash signatures.

A document is the set of its distinct five-word shingles. Its signature has 24
b-bit MinHash symbols in six chunks of four. By pigeonhole two signatures that
differ in at most 17 places agree, in some chunk, in at least two of the four
symbols, so six pairs of symbols per chunk (a chunk with two errors allowed,
enumerated) are the 36 index keys of a document: every pair within distance 17
meets under a key. At similarity 0.75 a pair is further apart once in a
million, and even then shares no key once in fifty million.

Equal sets are one class from the start. Keys with few classes give their
pairs. Under larger keys the classes are first tied along sorted orders of
their sketches, those links are confirmed and contracted, and only classes
still in different components are then compared, in blocks. So copies are
never expanded into all pairs, and no link between components is lost. Every
candidate is confirmed on the full shingle sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE_TABLE, binary, buffers, chunks, gram_hashes, mix, signed, stage, word_hashes
from docloom.llm.components import components

SHINGLE = 5
SIMILARITY = 75  # per cent
CHUNKS, WIDTH, ERRORS = 6, 4, 2
SKETCH = 128  # one-byte symbols that weed out candidates
SKETCH_AGREE = 74  # a pair at similarity 0.75 agrees in 96 on average, with deviation 4.9
SMALL = 16  # classes under a key whose pairs are listed at once
BLOCK = 2048  # classes of a large key compared in one task

_SEEDS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FACTORS = mix(_SEEDS) | np.uint64(1)


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words are one shingle."""
    if not len(words):
        return words
    return np.unique(gram_hashes(words, min(size, len(words))))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The least image of the set under each of the hash functions."""
    best = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = (shingles[at : at + 2048, None] ^ _SEEDS) * _FACTORS
        np.minimum(best, part.min(axis=0), out=best)
    return mix(best)


def _sets(batches, id_col, text_col):
    """Every document's shingle set, as a binary column."""
    for batch, data, offsets in chunks(batches, text_col):
        _, _, words, first = word_hashes(data, offsets, SPACE_TABLE)
        sets = [shingle_set(words[first[r] : first[r + 1]]) for r in range(batch.num_rows)]
        yield batch.column(batch.schema.get_field_index(id_col)), sets


def _node(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        halves = np.array([shingles.sum(dtype=np.uint64), mix(shingles ^ _SEEDS[0]).sum(dtype=np.uint64)], np.uint64)
        return mix(halves + np.uint64(len(shingles))).tobytes()


def _sign(id_col, text_col):
    def run(batches):
        for ids, sets in _sets(batches, id_col, text_col):
            signatures = [minhashes(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    binary([_node(s) if len(s) else None for s in sets]),
                    binary([None if s is None else s[: CHUNKS * WIDTH].astype(np.uint32).tobytes() for s in signatures]),
                    binary([None if s is None else (s >> np.uint64(40)).astype(np.uint8).tobytes() for s in signatures]),
                ],
                ["id", "n", "node", "signature", "sketch"],
            )

    return run


def _keys(batches):
    """The index keys of each signature."""
    for batch in batches:
        if not batch.num_rows:
            continue
        symbols = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        kept = list(combinations(range(WIDTH), WIDTH - ERRORS))
        keys = np.zeros((len(symbols), CHUNKS, len(kept)), np.uint64)
        for nth, places in enumerate(kept):
            for place in places:
                keys[:, :, nth] = keys[:, :, nth] * np.uint64(0x9E3779B97F4A7C15) + symbols[:, :, place]
        keys = mix(keys + (np.arange(CHUNKS * len(kept), dtype=np.uint64) << np.uint64(33)).reshape(CHUNKS, len(kept)))
        nodes = np.repeat(np.frombuffer(b"".join(batch.column("node").to_pylist()), "V16"), CHUNKS * len(kept))
        yield pa.RecordBatch.from_arrays([signed(keys.reshape(-1)), _nodes(nodes)], ["key", "node"])


def _nodes(nodes: np.ndarray) -> pa.Array:
    return binary(data=np.frombuffer(nodes.tobytes(), np.uint8), offsets=np.arange(len(nodes) + 1) * 16)


def _void(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of one width as an array of fixed-size items."""
    return np.frombuffer(b"".join(column.to_pylist()), f"V{width}")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _whole_groups(batches, least: int):
    """Batches sorted by ``key`` joined so that no key is cut, in pieces of
    about ``least`` rows or one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = table.column("key").to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _small_pairs(batches):
    """Pairs of the classes under small keys; classes under large keys as they are.

    Keys come sorted. A key is cut at the end of a batch, not gathered: while
    more than ``SMALL`` of it have been seen its rows pass through.
    """
    open_key, open_nodes, passing = None, np.zeros(0, "V16"), False
    empty = np.zeros(0, "V16")

    def out(a, b, keys, big):
        pairs = pa.RecordBatch.from_arrays([_nodes(a), _nodes(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])
        rows = pa.RecordBatch.from_arrays([_nodes(big), pa.nulls(len(big), pa.binary()), pa.array(keys, pa.int64())], ["a", "b", "key"])
        return pa.Table.from_batches([pairs, rows]).combine_chunks().to_batches()

    def settle(keys, nodes):
        """Complete keys: pairs of the small, rows of the large."""
        at = _runs(keys)
        sizes = np.diff(at)
        lefts, rights = [empty], [empty]
        for size in range(2, SMALL + 1):
            rows = at[:-1][sizes == size]
            if len(rows):
                block = nodes[rows[:, None] + np.arange(size)]
                i, j = np.triu_indices(size, 1)
                lefts.append(block[:, i].reshape(-1))
                rights.append(block[:, j].reshape(-1))
        large = np.repeat(sizes > SMALL, sizes)
        return np.concatenate(lefts), np.concatenate(rights), keys[large], nodes[large]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        nodes = _void(batch.column("node"), 16)
        if passing:
            more = int(np.searchsorted(keys != open_key, True))
            if more:
                yield from out(empty, empty, keys[:more], nodes[:more])
            keys, nodes = keys[more:], nodes[more:]
            if not len(keys):
                continue
            passing = False
        elif len(open_nodes):
            keys, nodes = np.concatenate([np.full(len(open_nodes), open_key), keys]), np.concatenate([open_nodes, nodes])
        last = int(_runs(keys)[-2])
        yield from out(*settle(keys[:last], nodes[:last])) if last else ()
        open_key, open_nodes = keys[last], nodes[last:]
        if len(open_nodes) > SMALL:
            yield from out(empty, empty, keys[last:], open_nodes)
            passing, open_nodes = True, empty
    if len(open_nodes):
        yield from out(*settle(np.full(len(open_nodes), open_key), open_nodes))


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def _alike(batches):
    """Pairs of close size whose sketches agree often enough."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array(_agree(a, b) >= SKETCH_AGREE))


def _tie(batches):
    """Under each large key: for three sorted orders of the sketches, every
    class with its better neighbour in that order, if alike. Ties only save
    comparisons later, so a key may be cut at the end of a batch."""
    for batch in batches:
        if batch.num_rows < 2:
            continue
        keys, nodes = batch.column("key").to_numpy(zero_copy_only=False), _void(batch.column("node"), 16)
        sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        lefts, rights = [], []
        for turn in (0, 43, 86):
            turned = np.ascontiguousarray(np.roll(sketches, -turn, axis=1))
            order = np.lexsort([*turned.T[7::-1], keys])
            a, b = order[:-1], order[1:]
            score = np.where(keys[a] == keys[b], _agree(sketches[a], sketches[b]), 0)
            up, down = np.append(score, 0), np.insert(score, 0, 0)
            other = np.where(up >= down, np.append(b, 0), np.insert(a, 0, 0))
            good = np.maximum(up, down) >= SKETCH_AGREE
            lefts.append(nodes[order[good]])
            rights.append(nodes[other[good]])
        yield pa.RecordBatch.from_arrays([_nodes(np.concatenate(lefts)), _nodes(np.concatenate(rights))], ["a", "b"])


def _across(percent):
    """Under each block pair of a large key: links that tie components.

    Classes of different components are compared by size and sketch, then on
    their full sets, until their components are tied; so a key gives fewer
    links than it has components, never all of its pairs.
    """

    def run(batches):
        for batch in _whole_groups(batches, 2048):
            keys, nodes = batch.column("key").to_numpy(zero_copy_only=False), _void(batch.column("node"), 16)
            roots = np.frombuffer(_void(batch.column("root"), 16).tobytes(), np.uint64).reshape(-1, 2)
            sides = batch.column("side").to_numpy(zero_copy_only=False)
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            values, offsets = buffers(batch.column("shingles"))
            values, offsets = np.ascontiguousarray(values).view(np.uint64), offsets // 8
            sizes = np.diff(offsets)
            left, right = [], []
            at = _runs(keys)
            for start, end in zip(at[:-1].tolist(), at[1:].tolist()):
                own = slice(start, end)
                _, code = np.unique(roots[own, 0] * _FACTORS[0] + roots[own, 1], return_inverse=True)
                common, side, size, sketch = np.bincount(code).argmax(), sides[own], sizes[own], sketches[own]
                for x in np.flatnonzero(code != common):  # of two components one is not the commonest
                    near = (code != code[x]) & ((side != side[x]) | (side == 2))
                    near &= (np.minimum(size, size[x]) * 100 >= percent * np.maximum(size, size[x]))
                    others = np.flatnonzero(near)
                    agree = _agree(sketch[others], sketch[x])
                    others = others[np.argsort(-agree, kind="stable")[: int((agree >= SKETCH_AGREE).sum())]]
                    mine = values[offsets[start + x] : offsets[start + x + 1]]
                    for few in np.split(others, [8, 64, 512]):  # the likeliest first
                        few = few[code[few] != code[x]]
                        if not len(few):
                            continue
                        theirs = np.concatenate([values[offsets[start + y] : offsets[start + y + 1]] for y in few])
                        found = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                        both = np.add.reduceat(found, np.concatenate([[0], np.cumsum(size[few])[:-1]]), dtype=np.int64)
                        for y in few[100 * both >= percent * (size[few] + size[x] - both)]:
                            if code[y] != code[x]:
                                left.append(start + x), right.append(start + y)
                                code[code == code[x]] = code[y]
            if left:
                yield pa.RecordBatch.from_arrays([_nodes(nodes[left]), _nodes(nodes[right])], ["a", "b"])

    return run


def _full_sets(id_col, text_col):
    def run(batches):
        for _, sets in _sets(batches, id_col, text_col):
            yield pa.RecordBatch.from_arrays([binary([_node(s) for s in sets]), binary([s.tobytes() for s in sets])], ["node", "shingles"])

    return run


def _confirm(percent):
    def run(batches):
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for r, (a, b) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked[r] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``: one row per row of ``docs``.

    component_id is the smallest id reachable over links (similarity of at
    least ``percent`` per cent, at most 100 and not under 75, for which the
    signature is sized). Rows with equal sets are one class. A null or blank
    text has no shingles and is its own component. A row without an id never
    names a component; alone, its component is null and it is kept. Repeated
    ids are separate rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed_docs = stage(docs.mapInArrow(_sign("id", "text"), "id long, n long, node binary, signature binary, sketch binary"), "signatures")
    classes = stage(
        signed_docs.where("node IS NOT NULL AND id IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "n", "signature", "sketch")).alias("c")).select("node", "c.*"),
        "classes",
    )
    keys = classes.select("node", "signature").mapInArrow(_keys, "key long, node binary")
    found = stage(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_small_pairs, "a binary, b binary, key long"), "found")
    sketches = classes.select("node", "n", "sketch")
    pairs = _with_sketches(_ordered(found.where("b IS NOT NULL")), sketches).mapInArrow(_alike, "a binary, b binary")
    large = stage(found.where("b IS NULL").select("key", F.col("a").alias("node")).join(sketches, "node"), "large")
    # A large key is cut by three symbols of the sketch: ties need not be complete here.
    cut = large.select(F.xxhash64("key", F.substring("sketch", 121, 3)).alias("key"), "node", "sketch")
    ties = cut.repartition("key").sortWithinPartitions("key", "sketch").mapInArrow(_tie, "a binary, b binary")
    pairs = stage(_ordered(pairs.union(ties)), "pairs")

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    chosen = classes.join(wanted, "node", "left_semi").select("id").distinct()
    texts = docs.where("id IS NOT NULL").join(chosen, "id", "left_semi")
    sets = stage(texts.mapInArrow(_full_sets("id", "text"), "node binary, shingles binary").dropDuplicates(["node"]), "sets")
    links = stage(_confirmed(pairs, sets, percent), "confirmed")
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    open_large = stage(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "open")
    counts = open_large.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    blocks = _blocks(open_large.join(counts, "key").join(sets, "node"))
    across = stage(blocks.repartition("key").sortWithinPartitions("key").mapInArrow(_across(percent), "a binary, b binary").distinct(), "across")
    links = links.union(across)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    ids = signed_docs.groupBy("node").agg(F.min("id").alias("least"))
    of_class = ids.where("node IS NOT NULL").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = of_class.join(of_class.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = signed_docs.select("id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("id") == component, component.isNull())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _with_sketches(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    a = sketches.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    b = sketches.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * SIMILARITY
    return pairs.join(a, "a").join(b, "b").where(close).select("a", "b", "sketch_a", "sketch_b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_confirm(percent), "a binary, b binary")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of a key, repeated for each pair of blocks that they take part in."""
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(pair.alias("key"), "node", "root", "sketch", "shingles", side.cast("int").alias("side"))
