"""Benchmark decontamination with a positional inverted index.

The index is stored in shards of about SHARD_BYTES of training text. A shard
lists, for every term, the ordinals of its occurrences, and the words of each
of its rows. If the test set has at most VOCABULARY distinct terms, only these
are stored (they are all that a lookup can ask for), otherwise every term is.

Test windows are looked up in blocks of about BLOCK_WORDS words. A block first
reads how often its terms occur in the whole corpus. Per shard, a window starts
from the list of its rarest term, moved by the term's offset, and is cut down
by the lists of the next rarer terms until it is empty or every term agrees.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ALNUM_TABLE, binary, buffers, chunks, stage, word_hashes

WINDOW = 10
SHARD_BYTES = 4 << 20
VOCABULARY = 1 << 20
BLOCK_WORDS = 1 << 18

_INDEX = "shard long, row long, id long, term long, n long, postings binary"
_FLAGS = 1 << 20


def _postings(batches, vocabulary=None):
    """Shards: a row per document with its number of words, a row per term
    with the increasing ordinals of its occurrences as differences."""
    shard = TaskContext.get().partitionId() << 32
    flags = None
    if vocabulary is not None:
        flags = np.zeros(_FLAGS, bool)
        flags[vocabulary & np.uint64(_FLAGS - 1)] = True
    for batch, data, offsets in chunks(batches, "text", SHARD_BYTES):
        _, _, words, first = word_hashes(data, offsets, ALNUM_TABLE)
        rows = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, shard)), pa.array(np.arange(rows)), batch.column("id"), pa.nulls(rows, pa.int64()), pa.array(np.diff(first)), pa.nulls(rows, pa.binary())],
            ["shard", "row", "id", "term", "n", "postings"],
        )
        places = np.arange(len(words))
        if flags is not None and len(words):
            places = places[flags[words & np.uint64(_FLAGS - 1)]]
            at = np.minimum(np.searchsorted(vocabulary, words[places]), len(vocabulary) - 1)
            good = vocabulary[at] == words[places] if len(vocabulary) else np.zeros(len(places), bool)
            places = places[good]
        terms = words[places]
        order = np.argsort(terms, kind="stable")
        terms, places = terms[order], places[order].astype(np.int32)
        heads = np.concatenate([[0], np.flatnonzero(terms[1:] != terms[:-1]) + 1]).astype(np.int64) if len(terms) else np.zeros(0, np.int64)
        steps = places.copy()
        steps[1:] -= places[:-1]
        steps[heads] = places[heads]
        n = len(heads)
        lists = binary(data=steps.view(np.uint8), offsets=np.append(heads, len(terms)) * 4) if n else pa.nulls(0, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(terms[heads].view(np.int64)), pa.array(np.diff(np.append(heads, len(terms)))), lists],
            ["shard", "row", "id", "term", "n", "postings"],
        )
        shard += 1


def build_index(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """The stored index of ``docs(id, text)``; ``terms`` (sorted) limits it."""
    return stage(docs.mapInArrow(partial(_postings, vocabulary=terms), _INDEX), "postings")


def _item_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    _, _, words, first = word_hashes(*buffers(pa.array(texts, pa.string())), ALNUM_TABLE)
    return words, first


def _windows(texts: list[str | None], window: int):
    """``(item, words)`` of every window: matrix of hashes padded with 0, lengths, item numbers."""
    words, first = _item_words(texts)
    rows, lengths, items = [], [], []
    for r in range(len(texts)):
        own = words[first[r] : first[r + 1]]
        if 0 < len(own) <= window:
            rows.append(np.pad(own, (0, window - len(own)))[None])
        elif len(own):
            rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
        else:
            continue
        lengths.append(np.full(len(rows[-1]), min(len(own), window)))
        items.append(np.full(len(rows[-1]), r))
    if not rows:
        return np.zeros((0, window), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(lengths), np.concatenate(items)


def _merge(rows, items, low, high):
    """Overlapping or touching spans of one row and item joined."""
    order = np.lexsort((low, items, rows))
    rows, items, low, high = rows[order], items[order], low[order], high[order]
    keep_rows, keep_items, lows, highs = [], [], [], []
    for r, i, a, b in zip(rows.tolist(), items.tolist(), low.tolist(), high.tolist()):
        if keep_rows and keep_rows[-1] == r and keep_items[-1] == i and a <= highs[-1]:
            highs[-1] = max(highs[-1], b)
        else:
            keep_rows.append(r), keep_items.append(i), lows.append(a), highs.append(b)
    return keep_rows, keep_items, lows, highs


def _look_up(table: pa.Table, windows, lengths, items, counts, slack):
    """Matches within one shard. ``windows`` index the sorted terms of
    ``counts``; terms of a window are tried from the rarest."""
    terms, totals = counts
    term, row = table.column("term"), table.column("row")
    of_rows = table.filter(row.is_valid())
    order = np.argsort(of_rows.column("row").to_numpy())
    first = np.concatenate([[0], np.cumsum(of_rows.column("n").to_numpy()[order])])
    lists = table.filter(term.is_valid())
    n = int(first[-1])
    at = np.full(n, -1, np.int32)
    postings: dict[int, np.ndarray] = {}
    for value, steps in zip(lists.column("term").to_numpy().view(np.uint64), lists.column("postings")):
        k = int(np.searchsorted(terms, value))
        postings[k] = np.cumsum(np.frombuffer(steps.as_buffer(), np.int32), dtype=np.int64)
        at[postings[k]] = k
    width = windows.shape[1]
    used = np.arange(width) < lengths[:, None]
    rarity = np.where(used, totals[windows], np.iinfo(np.int64).max)
    ranked = np.argsort(rarity, axis=1, kind="stable")
    out = [[], [], [], []]
    rarest = windows[np.arange(len(windows)), ranked[:, 0]]
    for k in np.unique(rarest):
        if int(k) not in postings:
            continue
        own = np.flatnonzero(rarest == k)
        for part in np.array_split(own, max(1, len(own) * len(postings[int(k)]) >> 22)):
            w = np.repeat(part, len(postings[int(k)]))
            start = np.tile(postings[int(k)], len(part)) - ranked[w, 0]
            if slack is None:
                good = (start >= 0) & (start + lengths[w] <= n)
                w, start = w[good], start[good]
                good = np.searchsorted(first, start, "right") == np.searchsorted(first, start + lengths[w] - 1, "right")
                w, start = w[good], start[good]
                for nth in range(1, width):
                    place = ranked[w, nth]
                    good = (nth >= lengths[w]) | (at[np.minimum(start + place, n - 1)] == windows[w, place])
                    w, start = w[good], start[good]
                low, high = start, start + lengths[w]
            else:
                w, low, high = _near(w, start + ranked[w, 0], at, first, windows, lengths, slack)
            for x, y in zip(out, (np.searchsorted(first, low, "right") - 1, items[w], low, high)):
                x.append(y)
    rows, found, low, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    rows, found, low, high = _merge(rows, found, low - first[rows], high - first[rows])
    shard = table.column("shard")[0].as_py()
    return pa.table(
        {"shard": pa.array([shard] * len(rows), pa.int64()), "row": pa.array(rows, pa.int64()), "item": pa.array(found, pa.int64()), "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())}
    )


def _near(w, places, at, first, windows, lengths, slack):
    """The shortest spans of at most length + slack words that hold the place
    and all terms of the window, in any order."""
    keep, lows, highs = [], [], []
    for k, place in zip(w.tolist(), places.tolist()):
        need = set(windows[k, : lengths[k]].tolist())
        reach = int(lengths[k]) + slack
        r = np.searchsorted(first, place, "right") - 1
        a, b = max(first[r], place - reach + 1), min(first[r + 1], place + reach)
        seen: dict[int, int] = {}
        best = None
        for p in range(int(a), int(b)):
            if at[p] in need:
                seen[int(at[p])] = p
                if p >= place and len(seen) == len(need):
                    low = min(min(seen.values()), place)
                    if p + 1 - low <= reach and (best is None or p + 1 - low < best[1] - best[0]):
                        best = (low, p + 1)
        if best:
            keep.append(k), lows.append(best[0]), highs.append(best[1])
    return np.array(keep, np.int64), np.array(lows, np.int64), np.array(highs, np.int64)


def _lookup(windows, lengths, items, counts, slack):
    def run(table):
        return _look_up(table, windows, lengths, items, counts, slack)

    return run


def find_matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slack: int | None = None) -> DataFrame:
    """``(shard, row, item, low, high)``: word spans of the indexed texts that
    windows of ``items(item, text)`` match, joined per item where they touch.

    ``slack=None``: exact phrases. Otherwise proximity: all terms of a window,
    in any order, within that many words more than the window has. ``item`` is
    text. Items without words match nothing.
    """
    spark = index.sparkSession
    words = items.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), " "))), F.lit(0))).first()[0]
    blocks = max(1, -(-words // BLOCK_WORDS))
    found = None
    for block in range(blocks):
        chosen = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        rows = chosen.select("item", "text").collect()  # a block of the stated test set
        hashes, lengths, numbers = _windows([r.text for r in rows], window)
        terms = np.unique(hashes[np.arange(window) < lengths[:, None]])
        if not len(terms):
            continue
        asked = spark.createDataFrame(pa.table({"term": pa.array(terms.view(np.int64))}))
        lists = index.join(asked, "term", "left_semi")
        totals = np.zeros(len(terms), np.int64)
        for term, n in lists.groupBy("term").agg(F.sum("n")).collect():  # a row per asked term at most
            totals[np.searchsorted(terms, np.uint64(term % (1 << 64)))] = n
        places = np.searchsorted(terms, hashes).clip(max=len(terms) - 1)
        whole = totals[np.where(np.arange(window) < lengths[:, None], places, places[:, :1])].min(axis=1) > 0  # no term is absent
        look = _lookup(places[whole], lengths[whole], numbers[whole], (terms, totals), slack)
        # the heavy lists of the shard meet in one group of bounded size
        shards = lists.union(index.where("row IS NOT NULL").select(lists.columns))
        part = shards.groupBy("shard").applyInArrow(look, "shard long, row long, item long, low long, high long")
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(rows)), pa.int64()), "name": pa.array([None if r.item is None else str(r.item) for r in rows], pa.string())}))
        part = part.join(names, "item").select("shard", "row", F.col("name").alias("item"), "low", "high")
        found = part if found is None else found.union(part)
    return found if found is not None else spark.createDataFrame([], "shard long, row long, item string, low long, high long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(id, n_words, n_hit, items, spans)`` per row of ``docs``.

    n_hit: words inside any window of ``window`` item words; an item of fewer
    words is one window. items: sorted distinct ids as text of the items with a
    match; spans: their word ranges. Null texts have no words. Items with a
    null id match but are not listed. Rows with one id are separate rows.
    Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    distinct = items.mapInArrow(_distinct_terms, "term long").distinct()
    terms = None
    if distinct.count() <= VOCABULARY:
        terms = np.sort(distinct.toArrow().column("term").to_numpy().view(np.uint64))
    index = build_index(docs, terms)
    matches = find_matches(index, items, window)
    per_row = matches.groupBy("shard", "row").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(F.struct("low", "high"))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["end"], s["high"]).alias("end"), (acc["total"] + F.greatest(F.lit(0).cast("long"), s["high"] - F.greatest(acc["end"], s["low"]))).alias("total")
    )
    hit = F.aggregate("spans", start, step)["total"]
    rows = index.where("row IS NOT NULL").select("shard", "row", "id", F.col("n").alias("n_words"))
    out = rows.join(per_row, ["shard", "row"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
    )


def _distinct_terms(batches):
    for _, data, offsets in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(word_hashes(data, offsets, ALNUM_TABLE)[2]).view(np.int64))], ["term"])
