"""Exact top-k of every query over a collection, for any in-task scorer.

The work is a blocked matrix product: a task holds a block of queries, scores
Arrow batches of documents against all of them at once and keeps the best k
per query, so what is shuffled is at most ``tasks * queries * k`` rows and
never the pairs. No step groups documents by a value of theirs, so skewed
words or labels do not make a hot task.

Four layouts give the same result:

* few queries (checked by counting them): broadcast, documents stay put;
* many queries: both sides are cut into blocks by a hash of their ids, each
  (query block, document block) cell is one co-group of bounded size;
* queries that name blocks of documents: cells are made of neighbouring blocks,
  and a query goes to those in which it asks for one;
* many queries with filters: a query meets only the documents that have the
  rarest of its conditions, in cells of some conditions each.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.filter_join import SEPARATOR, FilterTable, rarest, with_keys
from docloom.session import shared_dir

BROADCAST_QUERIES = 4096  # rows
BROADCAST_CELLS = 4_000_000  # array elements over all query rows
CELL_QUERIES = 32_768  # queries of one co-group
CELL_ELEMENTS = 32_000_000  # array elements of either side of one co-group
KEYED_QUERIES = 256  # queries with filters aimed at in one cell
BLOCK_CELLS = 8  # cells aimed at for documents that lie in blocks
SCORE_BLOCK = 4_000_000  # scores computed at a time
WAITING_ROWS = 50_000  # rows that wait at least before they are sorted in
KEY = SEPARATOR * 2  # before a condition: the document is here for it


class Scorer:
    """Scores Arrow batches of documents against a table of queries."""

    def prepare(self, queries: pa.Table):
        """State shared by all batches of a task."""
        raise NotImplementedError

    def arranged(self, docs: pa.Table) -> pa.Table:
        """The documents of a cell in the order that is best for scoring."""
        return docs

    def scores(self, state, docs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
        """``[documents, queries]`` scores, higher is better, ``-inf`` = no
        result; and second scores that decide between equal ones, or None."""
        raise NotImplementedError

    def search(self, state, batches, best: Best) -> bool:
        """Add to ``best`` what scores enough, without the scores of all pairs;
        False for a scorer that computes them all."""
        return False

    def least_cells(self, pairs: int, cores: int) -> int:
        """Into how many cells the work is cut at least."""
        return 1


class Best:
    """Running best k rows per query.

    Rows wait until as many have come as are kept, so that a row takes part in
    a bounded number of sorts; until then ``floor`` may be too low, never too
    high.
    """

    def __init__(self, ks: np.ndarray, id_type: pa.DataType, digits: int | None = None, floor: np.ndarray | None = None):
        self.ks, self.digits = ks, digits
        self.floor = np.full(len(ks), -np.inf) if floor is None else floor  # score needed to be kept
        schema = pa.schema([("q", pa.int64()), ("id", id_type), ("score", pa.float64()), ("tie", pa.float64())])
        self.rows, self.waiting, self.n_waiting = schema.empty_table(), [], 0

    def add(self, ids: pa.Array, scores: np.ndarray, ties: np.ndarray | None, columns: np.ndarray | None = None):
        """All scores of some documents for all queries, or those of ``columns``."""
        n, own = len(scores), np.arange(len(self.ks)) if columns is None else columns
        ks, floor = self.ks[own], self.floor[own]
        for k in np.unique(ks):
            if n > k:  # the k-th best of this block already bounds the rest
                cols = np.flatnonzero(ks == k)
                kth = np.partition(scores[:, cols], n - k, axis=0)[n - k]
                floor[cols] = np.maximum(floor[cols], kth)
        self.floor[own] = floor
        d, q = np.nonzero((scores >= floor) & (scores > -np.inf))
        self._wait(ids, d, own[q], scores[d, q], None if ties is None else ties[d, q])

    def add_pairs(self, ids: pa.Array, d: np.ndarray, q: np.ndarray, scores: np.ndarray):
        """Scores of some pairs of documents and queries."""
        near = np.flatnonzero(scores >= self.floor[q])
        self._wait(ids, d[near], q[near], scores[near], None)

    def _wait(self, ids, d, q, scores, ties):
        if len(d):
            ties = np.zeros(len(d)) if ties is None else ties
            self.waiting.append(pa.table({"q": q, "id": ids.take(pa.array(d)), "score": scores, "tie": ties}).cast(self.rows.schema))
            self.n_waiting += len(d)
            if self.n_waiting >= max(WAITING_ROWS, len(self.rows)):
                self.settle()

    def settle(self):
        """Take in the rows that wait."""
        if not self.n_waiting:
            return
        rows = pa.concat_tables([self.rows, *self.waiting]).combine_chunks()
        self.waiting, self.n_waiting = [], 0
        qs, scores, ties = (rows[c].to_numpy() for c in ("q", "score", "tie"))
        ids = rows["id"].chunk(0)
        order = np.lexsort([ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else _ranks(ids), -ties, -scores, qs])
        qs = qs[order]
        first = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]])
        place = np.arange(len(qs)) - np.repeat(first, np.diff(np.r_[first, len(qs)]))
        kept, last = place < self.ks[qs], place == self.ks[qs] - 1
        self.rows = rows.take(pa.array(order[kept]))
        self.floor[qs[last]] = np.maximum(self.floor[qs[last]], scores[order[last]])


def _ranks(values: pa.Array) -> np.ndarray:
    """The place of each value in their order; equal values have one place."""
    return pc.rank(values, tiebreaker="dense").to_numpy()


def rounded(scores: np.ndarray, digits: int) -> np.ndarray:
    with np.errstate(over="ignore"):  # the score of unequal lengths stays as it is
        near = np.round(scores, digits)
    return np.where(np.isinf(near), scores, near)


def _run(scorer: Scorer, queries: pa.Table, batches, schema: pa.Schema, digits) -> pa.Table:
    """Best rows of a stream of document batches for a block of queries."""
    queries = queries.combine_chunks()
    state = scorer.prepare(queries)
    ks = queries["k"].to_numpy().astype("int64")
    filter_no = queries["filter_no"].to_numpy() if "filter_no" in queries.column_names else None
    filters = FilterTable(queries["conditions"].to_pylist()) if "conditions" in queries.column_names else None
    goals = queries["goal"].fill_null(-np.inf).to_numpy().copy() if "goal" in queries.column_names else None
    best = Best(ks, schema.field("id").type, digits, goals)
    if filter_no is not None or filters is not None or not scorer.search(state, batches, best):
        _score_all(scorer, state, batches, best, filter_no, filters)
    best.settle()
    found = queries.select(["query_id", "k"]).take(best.rows["q"])
    columns = [found["query_id"], best.rows["id"], best.rows["score"], best.rows["tie"], found["k"]]
    return pa.table(columns, names=schema.names).cast(schema)


def _score_all(scorer: Scorer, state, batches, best: Best, filter_no, filters) -> None:
    step = max(1, SCORE_BLOCK // max(1, len(best.ks)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            scores, ties = scorer.scores(state, part)
            if best.digits is not None:
                scores = rounded(scores, best.digits)
                ties = ties if ties is None else rounded(ties, best.digits)
            if filter_no is not None:
                passes = part.column("passes").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                scores = np.where(passes[:, filter_no], scores, -np.inf)
            if filters is not None:
                scores = np.where(filters.passes(part.column("facts")), scores, -np.inf)
            best.add(part.column("id"), scores, ties)


def _run_cell(scorer: Scorer, queries: pa.Table, docs: pa.Table, schema: pa.Schema, digits) -> pa.Table:
    """As :func:`_run` for a cell, whose ids are sorted once and then compared by their place."""
    ids = docs["id"].combine_chunks()
    order = pc.sort_indices(ids)
    places = np.empty(len(ids), "int64")
    places[order.to_numpy()] = np.arange(len(ids))
    docs = scorer.arranged(docs.set_column(docs.column_names.index("id"), "id", pa.array(places)))
    by_place = schema.set(schema.get_field_index("id"), pa.field("id", pa.int64()))
    found = _run(scorer, queries, docs.combine_chunks().to_batches(), by_place, digits)
    return found.set_column(1, schema.field("id"), ids.take(order.take(found["id"])))


def _blocks(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def size_of(df: DataFrame, elements) -> tuple[int, int]:
    """Counted size of one side: rows and array elements."""
    n_rows, n_elements = df.agg(F.count("*"), F.sum(elements)).first()
    return n_rows, n_elements or 0


def gates(queries: DataFrame) -> list[str]:
    """Columns of the documents that decide which queries may see them."""
    return [of_docs for of_docs, of_queries in (("passes", "filter_no"), ("facts", "conditions")) if of_queries in queries.columns]


def _cogrouped(left: DataFrame, right: DataFrame, score_cell, out: T.StructType) -> DataFrame:
    cell = [c for c in ("_cell", "_q", "_d") if c in left.columns]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(score_cell, out)


def _cut(queries: DataFrame, docs: DataFrame, scorer: Scorer, n_queries: int, n_cells: int, doc_size, cell_queries: int, cell_elements: int):
    """Every query block with every document block."""
    n_docs, n_elements = size_of(docs, doc_size)
    # empty arrays take space too: count one element per document
    d_blocks = max(1, math.ceil((n_docs + n_elements) / cell_elements))
    q_blocks = max(1, math.ceil(n_queries / cell_queries), math.ceil(n_cells / cell_elements))
    least = scorer.least_cells(n_queries * n_docs, docs.sparkSession.sparkContext.defaultParallelism)
    while q_blocks * d_blocks < least:  # a block more of the side whose blocks have more rows
        more_docs = n_docs * q_blocks > n_queries * d_blocks
        q_blocks, d_blocks = q_blocks + (not more_docs), d_blocks + more_docs
    left = _blocks(queries, "query_id", q_blocks).withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1))))
    right = _blocks(docs, "id", d_blocks).withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    return left.withColumnsRenamed({"_block": "_q", "_cell": "_d"}), right.withColumnsRenamed({"_block": "_d", "_cell": "_q"})


def _keyed(queries: DataFrame, docs: DataFrame, n_queries: int, doc_size, cell_queries: int, cell_elements: int):
    """Queries with conditions, and the documents that have the rarest one.

    Conditions are dealt into cells by their hash; a cell with many queries or
    documents is split by their ids, counted in elements. The rarest condition
    is marked on both sides, so that a query and a document meet over it only.
    """
    spark = docs.sparkSession
    # empty arrays take space too: count one element per document
    keys = rarest(queries.select("conditions"), docs, doc_size + 1)
    asked = queries.join(keys.select("conditions", "fact"), "conditions")
    cell = F.pmod(F.xxhash64("fact"), F.lit(max(1, math.ceil(n_queries / KEYED_QUERIES)))).cast("int").alias("_cell")
    of_fact = asked.groupBy("fact").agg(F.count("*").alias("asked")).join(keys.groupBy("fact").agg(F.max("elements").alias("elements")), "fact")
    of_fact = of_fact.select("fact", cell, "asked", "elements")
    parts = lambda c, most: F.greatest(F.ceil(F.sum(c) / most), F.lit(1)).cast("int")
    of_cell = of_fact.groupBy("_cell").agg(parts("asked", cell_queries).alias("q_blocks"), parts("elements", cell_elements).alias("d_blocks"))
    path = shared_dir(spark, "cells")
    of_fact.join(of_cell, "_cell").select("fact", "_cell", "q_blocks", "d_blocks").write.parquet(path)
    left_cells, right_cells = (spark.read.schema("fact string, _cell int, q_blocks int, d_blocks int").parquet(path) for _ in "qd")
    mark = F.concat(F.lit(KEY), "fact")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(left_cells, "fact").withColumns({"conditions": F.array_append("conditions", mark), "_q": block("query_id", "q_blocks")})
    left = left.select(*queries.columns, "_cell", "_q", every("d_blocks").alias("_d"))
    right = with_keys(docs, right_cells).withColumns({"facts": F.array_append("facts", mark), "_d": block("id", "d_blocks")})
    return left, right.select(*docs.columns, "_cell", every("q_blocks").alias("_q"), "_d")


def _by_block(queries: DataFrame, docs: DataFrame, scorer: Scorer, doc_size, cell_queries: int, cell_elements: int):
    """Every query with the documents of the blocks that it asks for
    (``blocks`` of the queries, ``block`` of the documents).

    A cell has some neighbouring blocks, or a part of a large one by id, and
    the queries that ask for any of them, split by their ids. Blocks are few,
    so their sizes are counted and sent.
    """
    # empty arrays take space too: count one element per document
    stored = docs.groupBy("block").agg(F.count("*").alias("n"), F.sum(doc_size + 1).alias("elements")).orderBy("block").collect()
    asked = {r["block"]: r["count"] for r in queries.select(F.explode("blocks").alias("block")).groupBy("block").count().collect()}
    most = min(cell_elements, math.ceil(sum(r["elements"] for r in stored) / BLOCK_CELLS))
    cell_of, filled, pairs = {}, [], []
    for r in stored:
        if not filled or filled[-1] + r["elements"] > most:
            filled, pairs = [*filled, 0], [*pairs, 0]
        cell_of[r["block"]] = len(filled) - 1
        filled[-1] += r["elements"]
        pairs[-1] += r["n"] * asked.get(r["block"], 0)
    first, last = min(cell_of, default=0), max(cell_of, default=0)
    numbers = lambda values: F.array(*(F.lit(v).cast("int") for v in values))
    cell = lambda block: F.get(numbers(cell_of.get(b) for b in range(first, last + 1)), block - first)
    left = queries.withColumn("_cell", F.explode(F.array_compact(F.array_distinct(F.transform("blocks", cell)))))
    left = left.withColumn("blocks", F.filter("blocks", lambda b: cell(b) == F.col("_cell")))
    sizes = left.groupBy("_cell").agg(F.count("*").alias("n"), F.sum(F.size("vector") + F.size("blocks")).alias("elements")).collect()
    task = sum(pairs) / scorer.least_cells(sum(pairs), docs.sparkSession.sparkContext.defaultParallelism)
    d_blocks = [max(1, math.ceil(n / cell_elements)) for n in filled]
    q_blocks = [1] * len(filled)
    for r in sizes:
        c = r["_cell"]
        q_blocks[c] = max(1, math.ceil(r["n"] / cell_queries), math.ceil(r["elements"] / cell_elements), math.ceil(pairs[c] / d_blocks[c] / max(1, task)))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.get(numbers(n), F.col("_cell"))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.get(numbers(n), F.col("_cell")) - 1))
    left = left.withColumn("_q", block("query_id", q_blocks)).withColumn("_d", every(d_blocks))
    right = docs.withColumn("_cell", cell(F.col("block"))).withColumn("_d", block("id", d_blocks)).withColumn("_q", every(q_blocks))
    return left, right


def topk_join(
    queries: DataFrame,
    docs: DataFrame,
    scorer: Scorer,
    bound: tuple[int, int],
    doc_size,
    digits: int | None = None,
    max_broadcast: int = BROADCAST_QUERIES,
    cell_queries: int = CELL_QUERIES,
    cell_elements: int = CELL_ELEMENTS,
) -> DataFrame:
    """``query_id, id, score, tie, rank``: the best k documents per query.

    ``queries`` has ``query_id`` and ``k`` besides what the scorer reads;
    ``docs`` has ``id``. If queries have a ``filter_no``, they only see
    documents whose ``passes`` array is true at that place; if they have
    ``conditions``, only documents whose ``facts`` hold them all; if they have
    ``blocks``, only documents whose ``block`` is one of them. A ``goal`` is a
    score that the k best of a query surely reach. ``bound`` gives
    the number of queries and of their array elements (see :func:`size_of`)
    and decides the layout; ``doc_size``, a column with the array elements of
    a document, sizes the cells of the second layout.
    ``digits`` rounds scores before ranking, so that equal documents tie
    whatever the order of sums.
    """
    spark = docs.sparkSession
    id_type, query_type = docs.schema["id"].dataType, queries.schema["query_id"].dataType
    out = (
        T.StructType()
        .add("query_id", query_type)
        .add("id", id_type)
        .add("score", "double")
        .add("tie", "double")
        .add("k", "integer")
    )
    arrow = pa.schema(
        [
            ("query_id", _arrow(query_type)),
            ("id", _arrow(id_type)),
            ("score", pa.float64()),
            ("tie", pa.float64()),
            ("k", pa.int32()),
        ]
    )
    n_queries, n_cells = bound
    if n_queries <= max_broadcast and n_cells <= BROADCAST_CELLS:
        shared = spark.sparkContext.broadcast(queries.toArrow())

        def score_partition(batches):
            table = shared.value
            if table.num_rows:
                yield from _run(scorer, table, batches, arrow, digits).to_batches()

        partial = docs.mapInArrow(score_partition, out)
    else:
        def score_cell(query_block: pa.Table, doc_block: pa.Table) -> pa.Table:
            if query_block.num_rows == 0 or doc_block.num_rows == 0:
                return arrow.empty_table()
            return _run_cell(scorer, query_block, doc_block, arrow, digits)

        parts, open_queries = [], queries
        if "conditions" in queries.columns:
            filtered = F.size("conditions") > 0
            open_queries = queries.where(~filtered)
            n_open, open_cells = size_of(open_queries, F.lit(1))
            n_cells = math.ceil(n_cells * open_cells / max(1, n_queries))
            parts.append(_cogrouped(*_keyed(queries.where(filtered), docs, n_queries - n_open, doc_size, cell_queries, cell_elements), score_cell, out))
            n_queries = n_open
        if "blocks" in queries.columns:
            parts.append(_cogrouped(*_by_block(queries, docs, scorer, doc_size, cell_queries, cell_elements), score_cell, out))
        elif n_queries or not parts:
            parts.append(_cogrouped(*_cut(open_queries, docs, scorer, n_queries, n_cells, doc_size, cell_queries, cell_elements), score_cell, out))
        partial = reduce(DataFrame.unionByName, parts)

    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("tie").desc(), "id")
    ranked = partial.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= F.col("k")).drop("k")


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]
