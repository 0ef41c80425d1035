"""Ranked text search by scanning a collection.

Scores follow BM25 with the sign turned: negative, smaller is better. The
document count, the mean length and the document frequencies are always those
of the whole collection; filters only choose which documents may be returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.filters import filter_column
from docloom.functions.text import with_tokens
from docloom.operators.match import Match, TokenView
from docloom.schema import wanted
from docloom.session import shared_dir

# The two free parameters of BM25 and the weight of a word that
# occurs in more than half of the documents.
K1 = 1.2
B = 0.75
COMMON_WORD_IDF = 1e-6


def idf(n_docs, df_term) -> Column:
    """Inverse document frequency, never zero or negative."""
    raw = F.ln((n_docs - df_term + F.lit(0.5)) / (df_term + F.lit(0.5)))
    return F.when(raw > 0, raw).otherwise(F.lit(COMMON_WORD_IDF))


def term_weight(tf, length, mean_length) -> Column:
    """Saturating, length-normalised term frequency."""
    norm = F.lit(1 - B) + F.lit(B) * length / mean_length
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * norm)


def bm25(counts: list[Column], idfs: list[Column], length, mean_length) -> Column:
    """Negated sum over the leaves, in query order."""
    total = F.lit(0.0)
    for tf, weight in zip(counts, idfs):
        total = total + F.when(tf > 0, weight * term_weight(tf, length, mean_length)).otherwise(F.lit(0.0))
    return -total


def text_stats(tokenized: DataFrame, match: Match, tokens="tokens") -> DataFrame:
    """One row over the whole collection: ``n_docs``, ``mean_length`` and the
    weight ``idf_0, idf_1, ...`` of each leaf."""
    view = TokenView(tokens)
    leaves = match.leaves()
    totals = tokenized.agg(
        F.count("*").cast("double").alias("n_docs"),
        F.sum(F.size(tokens)).alias("n_tokens"),
        *(F.count_if(view.has(leaf)).cast("double").alias(f"df_{n}") for n, leaf in enumerate(leaves)),
    )
    return totals.select(
        "n_docs",
        (F.col("n_tokens") / F.col("n_docs")).alias("mean_length"),
        *(idf(F.col("n_docs"), F.col(f"df_{n}")).alias(f"idf_{n}") for n in range(len(leaves))),
    )


def with_stats(df: DataFrame, stats: DataFrame, name="_stats") -> DataFrame:
    """Add a one-row DataFrame as a struct column.

    It is a scalar subquery: evaluated once, shipped as a constant, no join.
    The one-element explode keeps a single reference to it in the plan.
    """
    one = stats.select(F.struct("*").alias(name)).scalar()
    return df.select("*", F.explode(F.array(one)).alias(name))


def match_text(df: DataFrame, match: Match, filters: dict | None = None, text="content") -> DataFrame:
    """Documents that match, unranked."""
    hits = with_tokens(df.where(filter_column(filters)), text, "_tokens")
    return hits.where(match.matches(TokenView("_tokens"))).drop("_tokens")


def score_text(df: DataFrame, match: Match, filters: dict | None = None, text="content") -> DataFrame:
    """Every matching document with its ``score``."""
    leaves, view = match.leaves(), TokenView("_tokens")
    stats = text_stats(with_tokens(df.select(text), text, "_tokens"), match, "_tokens")
    hits = with_tokens(df.where(filter_column(filters)), text, "_tokens").where(match.matches(view))
    score = bm25(
        [view.count(leaf) for leaf in leaves],
        [F.col(f"_stats.idf_{n}") for n in range(len(leaves))],
        F.size("_tokens"),
        F.col("_stats.mean_length"),
    )
    return with_stats(hits, stats).withColumn("score", score).drop("_tokens", "_stats")


WINDOW_ROWS = 10_000  # rows ranked in one task; more are ranked by a distributed sort


def rank_all(scored: DataFrame, order: list[Column]) -> DataFrame:
    """Number all rows in order, without bringing them into one task.

    The sorted rows are written to the shared folder with their place in
    their partition; adding the sizes of the partitions before gives the rank.
    """
    spark = scored.sparkSession
    path = shared_dir(spark, "ranked")
    scored.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(scored.schema.add("_place", "long")).parquet(path)
    part = F.shiftright("_place", 33)  # the lower 33 bits count rows in a partition
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # one row per partition of the sort
    before = F.sum("_size").over(W.orderBy("_part")) - F.col("_size")
    placed = rows.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    rank = F.col("_place").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return placed.withColumn("rank", rank).drop("_part", "_place", "_before")


def best(scored: DataFrame, k: int | None, id="id", descending=False) -> DataFrame:
    """The k best rows with ``rank`` 1..k, or all rows without a limit; ties
    are ordered by id."""
    order = [F.col("score").desc() if descending else F.col("score").asc(), F.col(id).asc()]
    return ranked(scored, order, k)


def ranked(scored: DataFrame, order: list[Column], k: int | None) -> DataFrame:
    """The first k rows in an order (None: all) with their ``rank``."""
    k = wanted(k)
    if k is None or k > WINDOW_ROWS:
        rows = rank_all(scored, order)
        return rows if k is None else rows.where(F.col("rank") <= k)
    # the window sees only the k rows that the limit left
    return scored.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def search_text(
    df: DataFrame, match: Match, k: int | None = None, filters: dict | None = None, text="content", id="id"
) -> DataFrame:
    """The k best matches (None: all): columns of ``df`` plus ``score`` and ``rank``."""
    return best(score_text(df, match, filters, text), k, id)


def hydrate(hits: DataFrame, docs: DataFrame, id="id") -> DataFrame:
    """Bring the other columns of the documents to the hits of a search.

    Spark knows from the limit in a top-k search that the hits are few and
    broadcasts them; unlimited hits are joined by a shuffle.
    """
    extra = [c for c in docs.columns if c == id or c not in hits.columns]
    return docs.select(*extra).join(hits, id)
