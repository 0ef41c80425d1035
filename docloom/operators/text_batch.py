"""Many text queries in one pass over a collection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import tokens, with_tokens
from docloom.operators.fulltext import B, K1, idf, with_stats
from docloom.operators.topk_join import Scorer, gates, size_of, topk_join
from docloom.operators.vector import score_lists, vectors_by_length
from docloom.schema import DEFAULT_LIMIT
from docloom.session import shared_dir

BROADCAST_WORDS = 1_000_000  # query words
PAIR_BLOCK = 4_000_000  # word-query pairs expanded at a time


class TextScorer(Scorer):
    """BM25 of documents against queries
    (``query_id, k, words, weights, n_words, every_word, mean_length``).

    Documents have ``id`` and either ``tokens`` or, from an index, the counted
    ``words`` the queries ask for with their ``counts`` and the ``length``.
    """

    def prepare(self, queries):
        words = queries["words"].chunk(0)
        lengths = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")  # queries of a word side by side
        per_word = np.bincount(codes, minlength=len(coded.dictionary))
        query_of = np.repeat(np.arange(len(lengths)), lengths)
        return {
            "vocabulary": coded.dictionary,
            "start": np.r_[0, np.cumsum(per_word)],
            "query": query_of[order],
            "weight": queries["weights"].chunk(0).flatten().to_numpy(zero_copy_only=False)[order],
            "need": np.where(queries["every_word"].to_numpy(), np.maximum(queries["n_words"].to_numpy(), 1), 1),
            "mean_length": queries["mean_length"].to_numpy()[0] if queries.num_rows else 1.0,
        }

    def scores(self, state, docs):
        total, keep = self.totals(state, docs)
        return np.where(keep, total, -np.inf), None

    @staticmethod
    def _frequencies(state, docs: pa.RecordBatch):
        """Document lengths, and document, word and count of each occurrence
        of a query word."""
        counted = "counts" in docs.schema.names
        lists = docs.column("words" if counted else "tokens")
        per_doc = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        code = pc.index_in(lists.flatten(), state["vocabulary"])
        known = code.is_valid().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), per_doc)[known]
        word = code.drop_null().to_numpy(zero_copy_only=False).astype("int64")
        if counted:
            lengths = docs.column("length").to_numpy(zero_copy_only=False)
            return lengths, doc, word, docs.column("counts").flatten().to_numpy(zero_copy_only=False)[known]
        n_words = max(1, len(state["vocabulary"]))
        cell, tf = np.unique(doc * n_words + word, return_counts=True)
        return per_doc, cell // n_words, cell % n_words, tf

    def totals(self, state, docs: pa.RecordBatch):
        """Sums of word contributions, and which pairs match."""
        n_docs, n_queries = docs.num_rows, len(state["need"])
        lengths, doc, word, tf = self._frequencies(state, docs)
        norm = K1 * ((1 - B) + B * lengths[doc] / state["mean_length"])
        part = tf * (K1 + 1) / (tf + norm)
        fan = state["start"][word + 1] - state["start"][word]  # queries asking for it

        total = np.zeros(n_docs * n_queries)
        found = np.zeros(n_docs * n_queries)
        ends = np.cumsum(fan)
        at = 0
        while at < len(fan):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIR_BLOCK, "right")))
            reps = fan[at:stop]
            within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            entry = np.repeat(state["start"][word[at:stop]], reps) + within
            target = np.repeat(doc[at:stop], reps) * n_queries + state["query"][entry]
            total += np.bincount(target, np.repeat(part[at:stop], reps) * state["weight"][entry], len(total))
            found += np.bincount(target, minlength=len(found))
            at = stop
        keep = found.reshape(n_docs, n_queries) >= state["need"]
        return total.reshape(n_docs, n_queries), keep


class HybridScorer(TextScorer):
    """Text matches in the order of their vectors: cosine first, then BM25.

    Matches without a vector come last. Both sides also have ``vector``. A
    query with a false ``by_vector`` is a plain text query.
    """

    NO_VECTOR = -2.0  # below every cosine

    def prepare(self, queries):
        vectors = list(vectors_by_length(queries["vector"].chunk(0)))
        return {**super().prepare(queries), "vectors": vectors, "by_vector": queries["by_vector"].to_numpy()}

    def scores(self, state, docs):
        total, keep = self.totals(state, docs)
        vectors = docs.column("vector")
        cosine = score_lists("cosine", vectors, state["vectors"])
        has_vector = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False) > 0
        cosine = np.where(has_vector[:, None], cosine, self.NO_VECTOR)
        first = np.where(state["by_vector"], cosine, total)
        return np.where(keep, first, -np.inf), np.where(state["by_vector"], total, 0.0)


def query_words(queries: DataFrame) -> DataFrame:
    """``query_id, word, times``."""
    return queries.select("query_id", F.explode(tokens("query")).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))


def count_words(words: DataFrame, tokenized: DataFrame, n_words: int) -> tuple[DataFrame, DataFrame]:
    """``word, df`` of the asked words, and ``n_docs, n_tokens`` as one row.

    One pass over a collection: the empty word, which no tokenizer returns,
    stands for the document itself. The counts, a row per asked word, are
    stored, so that both results come from that pass.
    """
    marks = tokenized.select(
        F.explode(F.concat(F.array(F.lit("")), F.array_distinct("tokens"))).alias("word"),
        F.size("tokens").alias("length"),
    )
    spark = tokenized.sparkSession
    asked = words.select("word").union(spark.createDataFrame([("",)], "word string")).distinct()
    per_word = [F.count("*").cast("double").alias("df"), F.sum("length").alias("n_tokens")]
    if n_words <= BROADCAST_WORDS:
        counts = marks.join(F.broadcast(asked), "word", "left_semi").groupBy("word").agg(*per_word)
    else:  # partial counts shrink the collection's side before it is shuffled
        counts = marks.groupBy("word").agg(*per_word).join(asked, "word", "left_semi")
    path = shared_dir(spark, "counts")
    counts.write.parquet(path)
    counts = spark.read.schema(counts.schema).parquet(path)
    whole = counts.where("word = ''").agg(F.max("df").alias("n_docs"), F.max("n_tokens").alias("n_tokens"))
    return counts.where("word <> ''").select("word", "df"), whole


def weigh_queries(queries: DataFrame, words: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Queries with their words and BM25 weights. ``totals`` (one row) comes
    in as a scalar, so no key of the joins is hotter than its word."""
    entry = F.when(F.col("df").isNotNull(), F.struct("word", "times", "df"))
    per_query = words.join(counts, "word", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.count("*").alias("n_words"))
    every = with_stats(queries.drop("query").join(per_query, "query_id", "left"), totals, "_total")
    return every.select(
        *(c for c in queries.columns if c != "query"),
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        (F.col("_total.n_tokens") / F.col("_total.n_docs")).alias("mean_length"),
        F.coalesce("entries.word", F.array().cast("array<string>")).alias("words"),
        F.coalesce(F.transform("entries", lambda e: e["times"] * idf(F.col("_total.n_docs"), e["df"])), F.array().cast("array<double>")).alias("weights"),
    )


def with_options(queries: DataFrame, k: int, every_word: bool) -> DataFrame:
    for name, default in {"k": F.lit(int(k)), "every_word": F.lit(every_word)}.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, default)
    return queries


def _prepared(queries: DataFrame, docs: DataFrame, text: str, k: int, every_word: bool):
    """Weighted queries, tokenized documents, and the size of the queries."""
    queries = with_options(queries, k, every_word)
    tokenized = with_tokens(docs, text).drop(text)
    bound = size_of(queries, F.size(tokens("query")))
    words = query_words(queries)
    return weigh_queries(queries, words, *count_words(words, tokenized.select("tokens"), bound[1])), tokenized, bound


def search_text_batch(
    queries: DataFrame,
    docs: DataFrame,
    k: int = DEFAULT_LIMIT,
    every_word: bool = False,
    text="content",
    digits: int | None = None,
    **layout,
) -> DataFrame:
    """The k best documents of every query text: ``query_id, id, score, rank``.

    ``queries``: ``query_id, query`` and optionally ``k``, ``every_word`` and
    ``filter_no``; ``docs``: ``id``, the text, and ``passes`` (one boolean per
    filter) if ``filter_no`` is used. A query matches documents with any of
    its words, or with all of them. A word given twice counts twice.
    """
    docs = docs.select("id", text, *gates(queries))
    ready, tokenized, bound = _prepared(queries, docs, text, k, every_word)
    return text_hits(ready, tokenized, bound, F.size("tokens"), digits, **layout)


def text_hits(ready: DataFrame, docs: DataFrame, bound: tuple[int, int], doc_size, digits: int | None = None, **layout) -> DataFrame:
    """Hits of weighted queries in documents as the scorer reads them."""
    hits = topk_join(ready, docs, TextScorer(), bound, doc_size, digits, **layout)
    return hits.drop("tie").withColumn("score", -F.col("score"))


def search_hybrid_batch(
    queries: DataFrame,
    docs: DataFrame,
    k: int = DEFAULT_LIMIT,
    every_word: bool = False,
    text="content",
    digits: int | None = None,
    **layout,
) -> DataFrame:
    """Text matches re-ranked by vector: ``query_id, id, score, text_score,
    rank``. As :func:`search_text_batch`, with a ``vector`` on both sides;
    every match is a candidate. ``score`` is NULL for matches without vector.

    Queries may have ``by_vector``; where it is false the query is answered
    as by :func:`search_text_batch` and both scores are the text score, so
    that text and hybrid queries share the passes over the documents.
    """
    if "by_vector" not in queries.columns:
        queries = queries.withColumn("by_vector", F.lit(True))
    docs = docs.select("id", text, "vector", *gates(queries))
    ready, tokenized, bound = _prepared(queries, docs, text, k, every_word)
    return hybrid_hits(queries, ready, tokenized, bound, F.size("tokens"), digits, **layout)


def hybrid_hits(
    queries: DataFrame, ready: DataFrame, docs: DataFrame, bound: tuple[int, int], doc_size, digits: int | None = None, **layout
) -> DataFrame:
    """As :func:`text_hits`, with vectors on both sides and ``by_vector`` in the queries."""
    n_queries, n_words = bound
    bound = n_queries, n_words + size_of(queries, F.size("vector"))[1]
    doc_size = doc_size + F.greatest(F.size("vector"), F.lit(0))
    hits = topk_join(ready, docs, HybridScorer(), bound, doc_size, digits, **layout)
    hits = hits.join(queries.select("query_id", "by_vector"), "query_id")
    cosine = F.when(F.col("score") > HybridScorer.NO_VECTOR, F.col("score"))
    return hits.select(
        "query_id",
        "id",
        F.when(F.col("by_vector"), cosine).otherwise(-F.col("score")).alias("score"),
        F.when(F.col("by_vector"), -F.col("tie")).otherwise(-F.col("score")).alias("text_score"),
        "rank",
    )
