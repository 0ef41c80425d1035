"""Mixing sources to target weights by Poisson replication.

Every document is repeated by a Poisson count whose mean is its source's
target repetition rate; the count inverts the distribution at a uniform number
that hashes the seed and the id, so it never depends on order or partitions.
Large means are sums of parts of at most PART, so no distribution table grows
with the mean. Copies are then dealt and sorted by a hash: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column, fresh, stage

PART = 32
SENT = 32 << 20  # bytes of rates that go to the tasks; a larger table is joined
SPLIT = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the joined parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, source_col: str, weights: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """``(source, parts, cdf)`` for each source: its rate is split into ``parts``
    equal means, whose cumulative chances ``cdf`` lists.

    ``weights(source, weight)`` are targets, not necessarily adding up to one;
    a source that it does not name has weight 0. Without it all sources weigh
    the same. ``total`` documents are expected; None: as many as there are.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.lit(1.0))
    else:
        named = weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight")).select(F.col("source").alias("named"), "weight")
        weighted = counts.join(named, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    all_weight = weighted.agg(F.sum("weight")).scalar()
    asked = weighted.agg(F.sum("n")).scalar() if total is None else F.lit(total)
    rate = F.when(F.col("all_weight") > 0, F.col("all_n") * F.col("weight") / (F.col("all_weight") * F.col("n"))).otherwise(0.0)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))

    def longer(acc, k):
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    last = F.ceil(F.col("mean") + 10 * F.sqrt("mean") + 20).cast("int")
    return (
        weighted.select("source", "n", "weight", all_weight.alias("all_weight"), asked.alias("all_n"))
        .select("source", rate.alias("rate"))
        .withColumn("parts", parts)
        .withColumn("mean", F.col("rate") / F.col("parts"))
        .select("source", "rate", "parts", F.aggregate(F.sequence(F.lit(1), last), start, longer)["cdf"].alias("cdf"))
    )


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, seed: int = 7, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """``docs`` with every row repeated by its count, ``copy`` (from 1) and
    ``mix_key``, by which the copies are dealt over the partitions and sorted.

    Rows with one id get the same count. A null source is a source; a null id
    counts as an empty one. Columns of ``docs`` named copy or mix_key are
    replaced; other names may be any. An empty table gives none.

    The rates are stored first. Up to SENT bytes of them are sent to the tasks,
    so that documents are shuffled only to be dealt; a larger table is repeated
    SPLIT times and met in as many parts of each source.
    """
    source = docs.drop("copy", "mix_key")
    own, parts, cdf, part, other, count = fresh(source, "_source", "_parts", "_cdf", "_part", "_other", "_count")
    plan = stage(rates(docs, source_col, weights, total).select(F.col("source").alias(own), F.col("parts").alias(parts), F.col("cdf").alias(cdf)), "rates")
    size = plan.agg(F.sum(F.coalesce(F.octet_length(F.col(own).cast("string")), F.lit(0)) + 8 * F.size(cdf) + 64)).first()[0] or 0
    same = column(source_col).eqNullSafe(F.col(own))
    if size <= SENT:
        joined = source.join(F.broadcast(plan), same)
    else:
        dealt = source.withColumn(part, F.pmod(F.xxhash64(column(id_col)), F.lit(SPLIT)).cast("int"))
        repeated = plan.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
        joined = dealt.join(repeated, same & (F.col(part) == F.col(other)))
    number = lambda j: uniform(F.lit(seed), column(id_col), j)
    drawn = F.transform(F.sequence(F.lit(1), F.col(parts)), lambda j: F.transform(F.array(number(j)), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))[0])
    copies = joined.withColumn(count, F.explode(F.array(F.aggregate(drawn, F.lit(0), lambda a, x: a + x)))).where(F.col(count) > 0)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count))))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(column(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary"))
    keyed = copies.select(*map(column, source.columns), "copy", order.alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key")
