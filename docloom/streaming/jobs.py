"""Continuous ingest and backfill with Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.embed import attempted
from docloom.session import remove_dir, shared_dir, shuffles_removed
from docloom.sources.collection import Collection, open_all
from docloom.sources.ingest import all_differ, to_documents

TICK = "10 seconds"


def _trigger(writer, once: bool):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TICK)


def store_batch(
    batch: DataFrame, target: Collection, note: str, embedder=None, embed="sync", order: str | None = None, as_of=None, keep: int | None = None
) -> None:
    """Store ingest records once: a batch whose note is already committed,
    because it is delivered again after a failure, is skipped.

    With ``keep``, files that none of so many newest versions uses are removed
    after the commit (:meth:`Collection.vacuum`), so that a stream does not
    fill the disk with versions that nobody reads.
    """
    if target.has_commit(note):
        return
    with shuffles_removed(batch.sparkSession, target.spark):
        # written first: ids drawn at random and vectors must be the same in
        # every pass over the batch
        staged = shared_dir(target.spark, "batch")
        docs = to_documents(batch, embedder, embed, as_of, order, all_differ(batch))
        docs.write.parquet(staged, compression="zstd")
        target.upsert(target.spark.read.schema(docs.schema).parquet(staged), as_of, note=note, stored=staged)
        remove_dir(target.spark, staged)
        if keep is not None:
            target.vacuum(keep)


def stream_upserts(records: DataFrame, target: Collection, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Store a stream of ingest records in a collection, and in its text index if it keeps one.

    Documents, index segment and the number of the batch are one commit, so a
    batch delivered again after a failure changes all of them or none.
    ``options`` are those of :func:`store_batch`.
    """

    def store(batch: DataFrame, number: int):
        store_batch(batch, target, f"{checkpoint}#{number}", **options)

    writer = records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return _trigger(writer, once).start()


_TRIED = "id string, vector array<float>, error string, created_at timestamp, db string, table string"


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """``db, table, id, tries, error`` from the error table of a backfill: how
    often each document failed, and the last message."""
    try:
        rows = spark.read.schema("id string, error string, db string, table string, at timestamp").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], "id string, error string, db string, table string, at timestamp")
    return rows.groupBy("db", "table", "id").agg(F.count("*").alias("tries"), F.max_by("error", "at").alias("error"))


def run_backfill(
    targets: list[Collection], embedder, n: int | None = None, as_of=None, note: str | None = None, errors: str | None = None, max_tries: int | None = None
) -> None:
    """One backfill cycle over several collections, all pending documents or
    ``n`` of them. With ``errors``, a path, failures are added to the table
    there, and documents that failed ``max_tries`` times are passed over.

    Only buckets in which documents wait are read (:meth:`Collection.queue`),
    and only collections that have any are written. A cycle without any ends
    with the newest commits read."""
    queues = [(t, q) for t, q in ((t, t.queue()) for t in targets) if q is not None]
    if not queues:
        return
    spark = targets[0].spark
    docs = reduce(DataFrame.unionByName, (q for _, q in queues))
    staged = shared_dir(spark, "vectors")  # embed once, then update each table
    failures = read_failures(spark, errors) if errors else None
    tried = attempted(docs, embedder, n, failures, max_tries)
    tried.select("id", "vector", "error", "created_at", "db", "table").write.partitionBy("db", "table").parquet(staged)
    done = spark.read.schema(_TRIED).parquet(staged)
    if errors:
        failed = done.where(F.col("vector").isNull()).select("id", "error", "db", "table", F.current_timestamp().alias("at"))
        failed.write.mode("append").parquet(errors)
    done = done.where(F.col("vector").isNotNull())
    if n is not None:
        done = done.orderBy("db", "table", "created_at", "id").limit(n)
    for target, _ in queues:
        mine = done.where((F.col("db") == target.db) & (F.col("table") == target.table)).select("id", "vector")
        target.update_vectors(mine, as_of, note)
    remove_dir(spark, staged)


def stream_backfill(
    ticks: DataFrame,
    targets: list[Collection] | str,
    embedder,
    checkpoint: str,
    n: int | None = None,
    as_of=None,
    once: bool = False,
    **options,
) -> StreamingQuery:
    """Run a backfill cycle for every micro-batch of a stream.

    ``targets`` are collections, or a folder whose collections are listed
    anew in every cycle. ``options`` are those of :func:`run_backfill`.

    ``ticks`` can be any stream: the ``rate`` source for a plain clock, or the
    stream of arriving documents.
    """

    def cycle(batch: DataFrame, number: int):
        found = open_all(batch.sparkSession, targets) if isinstance(targets, str) else targets
        if found:
            run_backfill(found, embedder, n, as_of, **options)

    writer = ticks.writeStream.foreachBatch(cycle)
    return _trigger(writer.option("checkpointLocation", checkpoint), once).start()
