"""Inverted index as tables: postings, document lengths, totals.

``postings(term, id, tf, length, positions)`` has one row per word and
document. Stored, it is laid out by a hash of the word, and inside that by a
hash of the document, so that a very common word is spread over several files
and a search opens only the files of its words. In a file the postings of a
word come in tiers, those that weigh most first, and by id inside a tier; the
reader passes over pages of other tiers and ids.

``cells(term, tier, n, tokens, max_tf, min_length, bucket)`` is the sorted
dictionary of a stored index: how many postings a tier of a word has, and the
most that one of them can weigh. It turns a prefix into directories, gives
word frequencies without reading postings, orders intersections from the
rarest word, and tells a search for the k best which tiers it can leave out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.filters import filter_column
from docloom.functions.text import tokens, with_tokens
from docloom.operators.fulltext import B, COMMON_WORD_IDF, K1, best, bm25, idf, term_weight, with_stats
from docloom.operators.match import AnyOf, ButNot, Leaf, Match, Near, PostingsView
from docloom.operators.text_batch import BROADCAST_WORDS, query_words, text_hits, weigh_queries, with_options
from docloom.operators.topk_join import size_of
from docloom.schema import DEFAULT_LIMIT
from docloom.session import list_dirs, remove_dir, shared_dir

TOKEN_BLOCK = 2_000_000  # tokens grouped at a time inside a task
FILE_ROWS = 4_000_000  # postings aimed at per stored file
MIN_BUCKETS = 16
TIERS = 8  # tiers per unit of a word's weight, which is below 2.2
MOST_TIERS = math.floor((K1 + 1) * TIERS) + 1
BROADCAST_GONE = 2_000_000  # replaced documents that are sent to the readers of an index, so that postings stay put
PAGE_ROWS = 2048  # rows of a page, the least that a reader can pass over
EARLY_ROWS = 1_000_000  # postings of the asked words from which a search for the k best looks at bounds first
LOOKUP = 64  # candidates whose other words are looked up by id

POSTINGS_DDL = "term string, id string, tf int, length int, positions array<int>"


def _ranks(values: pa.Array) -> np.ndarray:
    """The place of each value in their order."""
    order = pc.sort_indices(values).to_numpy()
    ranks = np.empty(len(order), "int64")
    ranks[order] = np.arange(len(order))
    return ranks


def _group_tokens(ids: pa.Array, token_lists: pa.Array, mean_length: float | None = None) -> pa.RecordBatch:
    """Words of some documents, grouped per document with their positions; with
    ``mean_length`` in the order of a stored index."""
    lengths = pc.list_value_length(token_lists).to_numpy(zero_copy_only=False).astype("int64")
    coded = token_lists.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(ids)), lengths)
    position = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key = doc * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    bounds = np.r_[first, len(key)].astype("int32")
    head = order[first]
    word, doc, tf = coded.indices.take(pa.array(head)), doc[head], np.diff(bounds)
    grouped = pa.record_batch(
        {
            "term": coded.dictionary.take(word),
            "id": ids.take(pa.array(doc)),
            "tf": tf,
            "length": lengths[doc].astype("int32"),
            "positions": pa.ListArray.from_arrays(pa.array(bounds), pa.array(position[order].astype("int32"))),
        }
    )
    if mean_length is None:
        return grouped
    tier = np.floor(tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * lengths[doc] / mean_length)) * TIERS).astype("int64")
    place = _ranks(coded.dictionary)[word.to_numpy(zero_copy_only=False)] * MOST_TIERS + (MOST_TIERS - 1 - tier)
    return grouped.take(pa.array(np.argsort(place * max(1, len(ids)) + _ranks(ids)[doc], kind="stable")))


def _group_batches(batches, mean_length=None):
    for batch in batches:
        ids, token_lists = batch.column("id"), batch.column("tokens")
        ends = np.cumsum(pc.list_value_length(token_lists).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ids):
            limit = (ends[at - 1] if at else 0) + TOKEN_BLOCK
            stop = max(at + 1, int(np.searchsorted(ends, limit, "right")))
            yield _group_tokens(ids.slice(at, stop - at), token_lists.slice(at, stop - at), mean_length)
            at = stop


def build_postings(df: DataFrame, text="content", mean_length: float | None = None) -> DataFrame:
    """Postings of a collection. All words of a document are in one row of the
    input, so they are grouped inside the task and nothing is shuffled.

    With ``mean_length``, each block of documents comes in the order of a stored
    index, so that laying out its files merges sorted runs.
    """
    tokenized = with_tokens(df.select("id", text), text).select("id", "tokens")
    return tokenized.mapInArrow(lambda batches: _group_batches(batches, mean_length), POSTINGS_DDL)


def document_lengths(df: DataFrame, text="content") -> DataFrame:
    """``id, length``: also the documents without any word."""
    return with_tokens(df.select("id", text), text).select("id", F.size("tokens").alias("length"))


class _CountView:
    """Counts of single words, one column per leaf."""

    def __init__(self, columns: dict):
        self.columns = columns

    def count(self, leaf: Leaf) -> Column:
        return F.col(self.columns[leaf.words[0], leaf.prefix])

    def has(self, leaf: Leaf) -> Column:
        return self.count(leaf) > 0


class _StartsView:
    """Places of leaves, one array column per leaf."""

    def __init__(self, columns: dict):
        self.columns = columns

    def starts(self, leaf: Leaf) -> Column:
        return F.coalesce(F.col(self.columns[_leaf_key(leaf)]), F.array().cast("array<int>"))

    def count(self, leaf: Leaf) -> Column:
        return F.size(self.starts(leaf))

    def has(self, leaf: Leaf) -> Column:
        return self.count(leaf) > 0


def _leaf_key(leaf: Leaf) -> tuple:
    return (*leaf.words, leaf.prefix, leaf.initial)


def _required(match: Match) -> set[tuple]:
    """Leaves without which no document matches."""
    if isinstance(match, Leaf):
        return {_leaf_key(match)}
    if isinstance(match, ButNot):
        return _required(match.keep)
    parts = [_required(p) for p in match.parts]
    return set.intersection(*parts) if isinstance(match, AnyOf) else set.union(*parts)


def _any_word(match: Match) -> bool:
    """A word, or any of some words."""
    parts = match.parts if isinstance(match, AnyOf) else [match]
    return all(isinstance(p, Leaf) and len(p.words) == 1 and not p.prefix and not p.initial for p in parts)


def _single_words(match: Match) -> bool:
    """True if word counts alone decide the match (no order, no distance)."""

    def plain(node):
        if isinstance(node, Leaf):
            return len(node.words) == 1 and not node.initial
        if isinstance(node, Near):
            return False
        return all(plain(p) for p in (node.parts if hasattr(node, "parts") else [node.keep, node.drop]))

    return plain(match)


CELLS_DDL = "term string, tier int, n long, tokens long, max_tf int, min_length int, bucket int"


def _place(postings: DataFrame, path: str, segment: int, buckets: int, splits: int, mean_length: float, mode: str) -> None:
    """Postings in a directory per bucket of words, ``splits`` files each, and
    the dictionary of their words and tiers."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    split = F.pmod(F.xxhash64("id"), F.lit(splits)).cast("int")
    tier = F.floor(term_weight(F.col("tf"), F.col("length"), F.lit(mean_length)) * TIERS).cast("int")
    # what follows from the other columns is added after the shuffle
    placed = postings.select("term", "id", "tf", "length", "positions").repartitionById(buckets * splits, bucket * splits + split)
    placed = placed.withColumns({"tier": tier, "bucket": bucket}).sortWithinPartitions("bucket", "term", F.desc("tier"), "id")
    place = f"{path}/postings/segment={segment}"
    placed.write.mode(mode).option("parquet.page.row.count.limit", PAGE_ROWS).option("compression", "zstd").partitionBy("bucket").parquet(place)
    rows = postings.sparkSession.read.schema("term string, tf int, length int, tier int, bucket int").parquet(place)
    counts = F.count("*").alias("n"), F.sum("tf").alias("tokens"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"), F.min("bucket").alias("bucket")
    cells = rows.groupBy("term", "tier").agg(*counts).repartitionByRange("term").sortWithinPartitions("term", "tier")
    cells.write.mode(mode).parquet(f"{path}/cells/segment={segment}")


def _commit(spark: SparkSession, path: str, segment: int, n_docs: float, n_tokens: int | None, buckets: int, mode: str) -> None:
    row = spark.createDataFrame([(float(n_docs), n_tokens, buckets)], "n_docs double, n_tokens long, buckets int")
    row.coalesce(1).write.mode(mode).parquet(f"{path}/totals/segment={segment}")


def _mean(n_docs: float, n_tokens: int | None) -> float:
    return n_tokens / n_docs if n_docs and n_tokens else 1.0


def _times(match: Match) -> dict[str, int]:
    """How often each word is asked for."""
    words = [leaf.words[0] for leaf in match.leaves()]
    return {w: words.count(w) for w in words}


class TextIndex:
    """Postings plus per-document lengths and collection totals.

    A stored index is a row of segments. A change adds a segment: the postings
    of its documents, and the ids whose earlier postings no longer count. The
    last thing written is the segment's totals; without them it is not read.
    """

    def __init__(
        self, postings: DataFrame, lengths: DataFrame, totals: DataFrame | None = None, buckets: int | None = None,
        path: str | None = None, segment: int = 0, cells: DataFrame | None = None, exact: bool = False, source: tuple | None = None,
    ):
        self.postings, self.lengths, self.buckets, self.path, self.segment = postings, lengths, buckets, path, segment
        self.cells, self.exact = cells, exact  # exact: the dictionary counts current documents only
        self.source = source  # documents and text column that the postings are built from
        self.totals = totals or lengths.agg(
            F.count("*").cast("double").alias("n_docs"), F.sum("length").alias("n_tokens")
        )

    @classmethod
    def build(cls, df: DataFrame, text="content") -> TextIndex:
        return cls(build_postings(df, text), document_lengths(df, text), source=(df, text))

    def write(self, path: str, buckets: int | None = None, splits: int | None = None, over_failed: bool = False) -> TextIndex:
        """Store under a new path: ``buckets`` directories by word, each in
        ``splits`` files by document. Returns the stored index.

        The defaults follow from the counts: a word has at most one posting
        per document, so even a word of every document stays within
        ``FILE_ROWS`` rows per file. ``over_failed`` replaces what a try that
        failed has left there.
        """
        spark, mode = self.postings.sparkSession, "overwrite" if over_failed else "errorifexists"
        self.lengths.write.mode(mode).parquet(f"{path}/lengths/segment=0")
        totals = TextIndex(self.postings, spark.read.schema("id string, length int").parquet(f"{path}/lengths/segment=0")).totals.first()
        splits = splits or max(1, math.ceil(totals["n_docs"] / FILE_ROWS))
        buckets = buckets or max(MIN_BUCKETS, math.ceil((totals["n_tokens"] or 0) / (splits * FILE_ROWS)))
        mean_length = _mean(*totals)
        rows = build_postings(*self.source, mean_length) if self.source else self.postings
        _place(rows, path, 0, buckets, splits, mean_length, mode)
        _commit(spark, path, 0, totals["n_docs"], totals["n_tokens"], buckets, mode)
        return TextIndex.read(spark, path, 0 if over_failed else None)

    @classmethod
    def read(cls, spark: SparkSession, path: str, upto: int | None = None) -> TextIndex:
        """A stored index, up to a segment (None: the last)."""
        segments = sorted(int(name.removeprefix("segment=")) for name in list_dirs(spark, f"{path}/totals"))
        segments = [n for n in segments if upto is None or n <= upto]

        def stored(kind, schema, which=segments):
            places = [f"{path}/{kind}/segment={n}" for n in which]
            return spark.read.schema(f"{schema}, segment int").option("basePath", f"{path}/{kind}").parquet(*places)

        totals = stored("totals", "n_docs double, n_tokens long, buckets int", segments[-1:])
        postings, lengths = stored("postings", f"{POSTINGS_DDL}, tier int, bucket int"), stored("lengths", "id string, length int")
        if len(segments) > 1:
            stale = stored("gone", "id string", segments[1:])
            few = stale.count() <= BROADCAST_GONE
            gone = stale.groupBy(F.col("id").alias("_gone")).agg(F.max("segment").alias("_at"))

            def alive(rows):  # no later segment has replaced or deleted the document
                return rows.join(F.broadcast(gone) if few else gone, (F.col("id") == F.col("_gone")) & (F.col("segment") < F.col("_at")), "left_anti")

            postings, lengths = alive(postings), alive(lengths)
        return cls(
            postings.drop("segment"), lengths.drop("segment"), totals.select("n_docs", "n_tokens"), totals.first()["buckets"], path, segments[-1],
            stored("cells", CELLS_DDL).drop("segment"), len(segments) == 1,
        )

    def append(self, changed: DataFrame, deleted: DataFrame | None = None, text="content", over_failed: bool = False) -> TextIndex:
        """Store a batch of new, changed and deleted documents as a segment.

        Only the batch is tokenized and written, and the totals are moved on
        by what it adds and removes. ``write`` to a new path joins all
        segments into one. ``over_failed`` replaces a segment that was written
        but, as the caller knows, never counted. Returns the index as it is now.
        """
        spark, path, number = self.postings.sparkSession, self.path, self.segment + 1
        if not over_failed and f"segment={number}" in list_dirs(spark, f"{path}/totals"):
            raise ValueError("the stored index has changed since it was read")
        staged = shared_dir(spark, "segment")  # every pass over the batch must see the same rows
        changed.select("id", F.col(text).alias("content")).write.parquet(staged, compression="zstd")
        fresh = spark.read.schema("id string, content string").parquet(staged)
        stale = fresh.select("id") if deleted is None else fresh.select("id").unionByName(deleted.select("id"))
        # new documents replace nothing
        stale.distinct().join(self.lengths.select("id"), "id", "left_semi").write.mode("overwrite").parquet(f"{path}/gone/segment={number}")
        document_lengths(fresh).write.mode("overwrite").parquet(f"{path}/lengths/segment={number}")
        gone = spark.read.schema("id string").parquet(f"{path}/gone/segment={number}")
        added = spark.read.schema("id string, length int").parquet(f"{path}/lengths/segment={number}")
        sums = [F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")]
        lost, won, before = self.lengths.join(gone, "id", "left_semi").agg(*sums).first(), added.agg(*sums).first(), self.totals.first()
        splits = max(1, math.ceil(won["n"] / FILE_ROWS))
        mean_length = _mean(won["n"], won["tokens"])
        _place(build_postings(fresh, mean_length=mean_length), path, number, self.buckets, splits, mean_length, "overwrite")
        _commit(spark, path, number, before["n_docs"] - lost["n"] + won["n"], (before["n_tokens"] or 0) - lost["tokens"] + won["tokens"], self.buckets, "overwrite")
        remove_dir(spark, staged)
        return TextIndex.read(spark, path, number)

    def update(self, changed: DataFrame, deleted: DataFrame | None = None, text="content") -> TextIndex:
        """The index after a batch of new, changed and deleted documents.

        Only the batch is tokenized. The result is lazy: search it as it is
        (a small batch is anti-joined by broadcast), or ``write`` it. To keep
        a change of a stored index, ``append`` it.
        """
        stale = changed.select("id")
        if deleted is not None:
            stale = stale.unionByName(deleted.select("id"))
        stale = stale.distinct()
        columns = ["term", "id", "tf", "length", "positions", *(["bucket"] if self.buckets else [])]
        fresh = build_postings(changed, text)
        if self.buckets:
            fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        postings = self.postings.join(stale, "id", "left_anti").select(*columns).unionByName(fresh)
        lengths = self.lengths.join(stale, "id", "left_anti").unionByName(document_lengths(changed, text))
        return TextIndex(postings, lengths, buckets=self.buckets)

    def _bucket(self, word: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(word)), F.lit(self.buckets)).cast("int")

    def _with_prefix(self, start: str) -> Column:
        """Postings whose word begins so; of a stored index, in the
        directories that the dictionary names (at most one row each)."""
        wanted = F.col("term").startswith(start)
        if self.cells is None:
            return wanted
        buckets = [r["bucket"] for r in self.cells.where(wanted).select("bucket").distinct().collect()]
        return F.col("bucket").isin(buckets) & wanted

    def lookup(self, leaves: list[Leaf]) -> DataFrame:
        """Postings of the words of some leaves; prunes directories and files."""
        exact = sorted({w for leaf in leaves for w in leaf.exact_words})
        open_ended = sorted({leaf.words[-1] for leaf in leaves if leaf.prefix})
        wanted = F.col("term").isin(exact)
        if self.buckets and exact:
            wanted &= F.col("bucket").isin([self._bucket(w) for w in exact])
        for start in open_ended:
            wanted |= self._with_prefix(start)
        return self.postings.where(wanted)

    def _word_rows(self, word: str, prefix: bool = False) -> DataFrame:
        """``id, length, positions`` of a word, or of all words that begin so."""
        if not prefix:
            return self.postings.where((F.col("bucket") == self._bucket(word)) & (F.col("term") == word)).select("id", "length", "positions")
        rows = self.postings.where(self._with_prefix(word))
        return rows.groupBy("id").agg(F.max("length").alias("length"), F.flatten(F.collect_list("positions")).alias("positions"))

    def _sizes(self, leaves: list[Leaf]) -> dict:
        """``(word, prefix)`` to its number of postings and of occurrences, from the dictionary."""
        exact = sorted({w for leaf in leaves for w in leaf.exact_words})
        sums = [F.sum("n").alias("n"), F.sum("tokens").alias("tokens")]
        sizes = {(w, False): (0, 0) for w in exact}
        sizes |= {(r["term"], False): (r["n"], r["tokens"]) for r in self.cells.where(F.col("term").isin(exact)).groupBy("term").agg(*sums).collect()}
        for start in {leaf.words[-1] for leaf in leaves if leaf.prefix}:
            row = self.cells.where(F.col("term").startswith(start)).agg(*sums).first()
            sizes[start, True] = (row["n"] or 0, row["tokens"] or 0)
        return sizes

    def _leaf_rows(self, leaf: Leaf, sizes: dict) -> tuple[DataFrame, tuple[int, int]]:
        """``id, length, starts`` of the documents with a leaf, and a bound of
        their number and occurrences.

        The words are intersected from the rarest on: what is left of a phrase
        goes to the next word's postings, which are reduced where they are
        read as long as the rarest word has few occurrences.
        """
        words = [(w, leaf.prefix and n == len(leaf.words) - 1) for n, w in enumerate(leaf.words)]
        order = sorted(range(len(words)), key=lambda n: sizes[words[n]])
        bound, found = sizes[words[order[0]]], None
        for n in order:
            shift = n
            own = self._word_rows(*words[n]).withColumn("positions", F.transform("positions", lambda p: p - F.lit(shift)))
            if found is None:
                found = own.withColumnRenamed("positions", "starts")
                continue
            few = F.broadcast(found) if bound[1] <= BROADCAST_WORDS else found
            met = own.drop("length").join(few, "id").select("id", "length", F.array_intersect("starts", "positions").alias("starts"))
            found = met.where(F.size("starts") > 0)
        if leaf.initial:
            found = found.withColumn("starts", F.filter("starts", lambda p: p == 0)).where(F.size("starts") > 0)
        return found, bound

    def _by_places(self, match: Match):
        """As :meth:`_by_document` for a stored index of one segment: every
        leaf gets its own rows, and those of a leaf that all matches need cut
        the rows of the others before they are grouped."""
        leaves = {_leaf_key(leaf): leaf for leaf in match.all_leaves()}
        sizes = self._sizes(list(leaves.values()))
        tables = {key: self._leaf_rows(leaf, sizes) for key, leaf in leaves.items()}
        required = _required(match)
        rarest = min(required, key=lambda key: tables[key][1], default=None)
        view = _StartsView({key: f"_s{i}" for i, key in enumerate(leaves)})
        rows = None
        for i, (key, (table, _)) in enumerate(tables.items()):
            if rarest is not None and key != rarest:
                ids, bound = tables[rarest]
                ids = ids.select("id")
                table = table.join(F.broadcast(ids) if bound[0] <= BROADCAST_WORDS else ids, "id", "left_semi")
            table = table.select("id", "length", "starts", F.lit(i).alias("leaf"))
            rows = table if rows is None else rows.unionByName(table)
        places = [F.max(F.when(F.col("leaf") == i, F.col("starts"))).alias(f"_s{i}") for i in range(len(leaves))]
        documents = rows.groupBy("id").agg(F.max("length").alias("length"), *places)

        def frequency(leaf):
            if len(leaf.words) == 1 and not leaf.prefix and not leaf.initial:
                return F.lit(float(sizes[leaf.words[0], False][0]))
            return tables[_leaf_key(leaf)][0].agg(F.count("*").cast("double")).scalar()

        return documents, view, self.totals.select(*(frequency(leaf).alias(f"df_{i}") for i, leaf in enumerate(match.leaves())))

    def _by_document(self, match: Match):
        """One row per document with the words asked for; its view; and the
        document frequency of each leaf as one row."""
        leaves = match.all_leaves()
        if self.exact and not _single_words(match):
            return self._by_places(match)
        rows = self.lookup(leaves)
        if not _single_words(match):
            words = F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("_words")
            documents = rows.groupBy("id").agg(F.max("length").alias("length"), words)
            return documents, PostingsView("_words"), self._frequencies(documents, PostingsView("_words"), match)
        keys = list(dict.fromkeys((leaf.words[0], leaf.prefix) for leaf in leaves))
        view = _CountView({key: f"_n{i}" for i, key in enumerate(keys)})
        hit = {key: F.col("term").startswith(key[0]) if key[1] else F.col("term") == key[0] for key in keys}
        if len(keys) == 1 and not keys[0][1]:  # a posting is a document: no grouping
            documents = rows.select("id", "length", F.col("tf").alias("_n0"))
        else:
            counts = [F.sum(F.when(hit[key], F.col("tf")).otherwise(0)).alias(view.columns[key]) for key in keys]
            documents = rows.groupBy("id").agg(F.max("length").alias("length"), *counts)
        if any(key[1] for key in keys):
            return documents, view, self._frequencies(documents, view, match)
        if self.exact:
            sizes = self._sizes(leaves)
            return documents, view, self.totals.select(*(F.lit(float(sizes[leaf.words[0], False][0])).alias(f"df_{i}") for i, leaf in enumerate(match.leaves())))
        # one posting per document: words are counted without grouping
        exact = [F.count_if(hit[leaf.words[0], False]).cast("double") for leaf in match.leaves()]
        return documents, view, rows.agg(*(n.alias(f"df_{i}") for i, n in enumerate(exact)))

    @staticmethod
    def _frequencies(documents: DataFrame, view, match: Match) -> DataFrame:
        counts = [F.count_if(view.has(leaf)).cast("double") for leaf in match.leaves()]
        return documents.agg(*(n.alias(f"df_{i}") for i, n in enumerate(counts)))

    def score(self, match: Match) -> DataFrame:
        """``id, score`` of every matching document."""
        leaves = match.leaves()
        documents, view, frequencies = self._by_document(match)
        n_docs, n_tokens = F.col("_total.n_docs"), F.col("_total.n_tokens")
        stats = with_stats(frequencies, self.totals, "_total").select(
            (n_tokens / n_docs).alias("mean_length"),
            *(idf(n_docs, F.col(f"df_{n}")).alias(f"idf_{n}") for n in range(len(leaves))),
        )
        hits = with_stats(documents.where(match.matches(view)), stats)
        idfs = [F.col(f"_stats.idf_{n}") for n in range(len(leaves))]
        counts = [view.count(leaf) for leaf in leaves]
        return hits.select("id", bm25(counts, idfs, F.col("length"), F.col("_stats.mean_length")).alias("score"))

    def search(self, match: Match, k: int | None = None) -> DataFrame:
        """The k best documents (None: all): ``id, score, rank``; see ``hydrate`` for the rest.

        For any of some words with many postings, :meth:`search_top` gives the
        same hits from fewer of them.
        """
        if k and self.exact and _any_word(match) and sum(n for n, _ in self._sizes(match.leaves()).values()) > EARLY_ROWS:
            return self.search_top(match, k)
        return best(self.score(match), k)

    def _bounds(self, words: dict[str, int]) -> tuple[dict, float, float]:
        """What a posting of each tier of a word can add to a score at most:
        ``{word: [(bound, tier, n), ...]}``, best first; document count; mean length."""
        n_docs, n_tokens = self.totals.first()
        mean = _mean(n_docs, n_tokens)
        rows = self.cells.where(F.col("term").isin(sorted(words))).collect()  # a few rows per word
        bounds = {}
        for word, times in words.items():
            own = sorted((r for r in rows if r["term"] == word), key=lambda r: r["tier"])
            df = sum(r["n"] for r in own)
            weight = times * max(math.log((n_docs - df + 0.5) / (df + 0.5)), COMMON_WORD_IDF)
            least, tiers = 0.0, []
            for r in own:  # no tier's bound is under that of a lower one
                part = r["max_tf"] * (K1 + 1) / (r["max_tf"] + K1 * (1 - B + B * r["min_length"] / mean))
                least = max(least, weight * part)
                tiers.append((least, r["tier"], r["n"]))
            if tiers:
                bounds[word] = tiers[::-1]
        return bounds, n_docs, mean

    def _tier_rows(self, lowest: dict[str, int]) -> DataFrame:
        """Postings of words down to a tier, without positions."""
        wanted = F.lit(False)
        for word, tier in lowest.items():
            wanted |= (F.col("bucket") == self._bucket(word)) & (F.col("term") == word) & (F.col("tier") >= tier)
        return self.postings.where(wanted).select("term", "id", "tf", "length")

    def needed_tiers(self, match: Match, k: int, bounds: dict, mean: float, n_docs: float) -> tuple[float, dict[str, int]]:
        """A score that the k best surely reach, and the lowest tier of each
        word that a document reaching it can be in.

        The score is the k-th best that the heaviest tiers give on their own. A
        document with a posting so light that all other words at their best do
        not lift it there is out, so lighter tiers need not be read.
        """
        probe, seen = {}, 0
        for _, tier, n, word in sorted(((b, t, n, w) for w, tiers in bounds.items() for b, t, n in tiers), key=lambda c: (-c[0], c[3], -c[1])):
            if seen >= max(PAGE_ROWS, 4 * k):
                break
            probe[word], seen = min(tier, probe.get(word, tier)), seen + n
        parts = self._partial(self._tier_rows(probe), match, n_docs, bounds, mean)
        reached = parts.orderBy(F.desc("part")).limit(k).agg(F.min("part"), F.count("*")).first()
        goal = reached[0] * (1 - 1e-9) if reached[1] == k else 0.0
        every = sum(tiers[0][0] for tiers in bounds.values())
        lowest = {w: min(t for b, t, _ in tiers if b + every - tiers[0][0] >= goal) for w, tiers in bounds.items()}
        return goal, lowest

    @staticmethod
    def _partial(rows: DataFrame, match: Match, n_docs: float, bounds: dict, mean: float) -> DataFrame:
        """``id, part``: what the given postings add to each score, sign turned."""
        times = _times(match)
        weight = F.lit(0.0)
        for word, tiers in bounds.items():
            own = F.lit(float(times[word])) * idf(F.lit(n_docs), F.lit(float(sum(n for _, _, n in tiers))))
            weight = F.when(F.col("term") == word, own).otherwise(weight)
        return rows.groupBy("id").agg(F.sum(weight * term_weight(F.col("tf"), F.col("length"), F.lit(mean))).alias("part"))

    def search_top(self, match: Match, k: int) -> DataFrame:
        """The k best documents with any of some words, exactly, leaving out
        postings that cannot matter.

        Words whose best tiers together stay below the goal cannot bring a
        document among the k best alone. So the others name the candidates,
        and of the common words only the candidates' postings are needed: a
        few are looked up by id, more are found by a semi-join.
        """
        if not (self.exact and _any_word(match)):
            raise ValueError("needs a stored index of one segment, and any of some single words")
        bounds, n_docs, mean = self._bounds(_times(match))
        if not bounds:
            return best(self.score(match), k)
        goal, lowest = self.needed_tiers(match, k, bounds, mean, n_docs)
        spare, optional = 0.0, []
        for word in sorted(bounds, key=lambda w: (bounds[w][0][0], w)):
            if spare + bounds[word][0][0] >= goal:
                break
            spare += bounds[word][0][0]
            optional.append(word)
        rows = self._tier_rows({w: t for w, t in lowest.items() if w not in optional})
        if optional:
            candidates = self._partial(rows, match, n_docs, bounds, mean).where(F.col("part") + spare >= goal).select("id")
            few = [r["id"] for r in candidates.limit(LOOKUP + 1).collect()]
            others = self._tier_rows({w: lowest[w] for w in optional})
            if len(few) <= LOOKUP:
                one_of = F.lit(False)
                for id in few:
                    one_of |= F.col("id") == id
                others = others.where(one_of)
            else:
                others = others.join(candidates, "id", "left_semi")
            rows = rows.unionByName(others)
        words = list(bounds)
        counts = [F.sum(F.when(F.col("term") == w, F.col("tf")).otherwise(0)).alias(f"_n{i}") for i, w in enumerate(words)]
        documents = rows.groupBy("id").agg(F.max("length").alias("length"), *counts)
        asked = [leaf.words[0] for leaf in match.leaves() if leaf.words[0] in bounds]
        idfs = [idf(F.lit(n_docs), F.lit(float(sum(n for _, _, n in bounds[w])))) for w in asked]
        score = bm25([F.col(f"_n{words.index(w)}") for w in asked], idfs, F.col("length"), F.lit(mean))
        return best(documents.select("id", score.alias("score")), k)

    def search_filtered(self, match: Match, docs: DataFrame, k: int | None = None, filters: dict | None = None) -> DataFrame:
        """As ``search`` over the documents that pass the filters."""
        allowed = docs.where(filter_column(filters)).select("id")
        return best(self.score(match).join(allowed, "id", "left_semi"), k)

    def search_batch(
        self, queries: DataFrame, k: int = DEFAULT_LIMIT, every_word: bool = False, digits: int | None = None, **layout
    ) -> DataFrame:
        """As ``search_text_batch``, reading only the postings of the words
        that the queries ask for."""
        queries = with_options(queries, k, every_word)
        size = size_of(queries, F.size(tokens("query")))
        words = query_words(queries)
        documents, counts, _ = self.candidates(words, size[1])
        ready = weigh_queries(queries, words, counts, self.totals)
        return text_hits(ready, documents, size, F.size("words"), digits, **layout)

    def candidates(self, words: DataFrame, n_words: int, cut: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        """What the postings of a table of ``n_words`` words say: documents
        ``id, length, words, counts``, the words' frequencies ``word, df``,
        and with ``cut``, if the dictionary shows that they are few enough to
        be sent to all tasks, the ids of the documents.
        """
        keys = words.select(F.col("word").alias("term")).distinct()
        on = ["term"]
        if self.buckets:  # the directories to read follow from the words
            keys = keys.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
            on = ["term", "bucket"]
        keys = F.broadcast(keys) if n_words <= BROADCAST_WORDS else keys
        rows = self.postings.join(keys, on, "left_semi").select("term", "id", "tf", "length")
        if self.exact:
            known = self.cells.join(keys.select("term"), "term", "left_semi")
            counts = known.groupBy(F.col("term").alias("word")).agg(F.sum("n").cast("double").alias("df"))
        else:
            counts = rows.groupBy(F.col("term").alias("word")).agg(F.count("*").cast("double").alias("df"))
        few = None
        if cut and self.exact and (counts.agg(F.sum("df")).first()[0] or 0) <= BROADCAST_WORDS:
            few = F.broadcast(rows.select("id").distinct())
        # one row per document with the asked words in it
        entries = F.collect_list(F.struct("term", "tf"))
        documents = rows.groupBy("id").agg(F.max("length").alias("length"), entries.alias("entries"))
        return documents.select("id", "length", F.col("entries.term").alias("words"), F.col("entries.tf").alias("counts")), counts, few

    def places(self, leaves: list[Leaf], within: DataFrame | None = None) -> DataFrame:
        """``id, places``: a map from each word of some leaves to its
        positions in a document; ``within`` names the documents wanted, and
        cuts the postings where they are read."""
        rows = self.lookup(leaves)
        if within is not None:
            rows = rows.join(within, "id", "left_semi")
        return rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"))
