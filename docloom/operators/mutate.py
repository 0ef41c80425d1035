"""Changes to a collection as DataFrame -> DataFrame transforms.

Each gives the next content of the collection. An upsert is one full outer
join of the collection with the batch, so both are read once, or, where the
ids of the batch can be sent, joins with these; a delete or an update of
vectors is an anti or left join, for which Spark broadcasts a small
batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.schema import DOCUMENT_COLUMNS, DOCUMENT_SCHEMA


def _as_of(as_of) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


def with_ids(batch: DataFrame) -> DataFrame:
    """Give documents without an id a random one."""
    return batch.withColumn("id", F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.uuid()).otherwise(F.col("id")))


def latest_per_id(batch: DataFrame, order: str | None = None, id="id") -> DataFrame:
    """One row per id: the one with the highest ``order`` value.

    An aggregate, so copies of one hot id are reduced before the shuffle.
    Without an order column nothing says which of two rows of an id is the
    last: equal rows count as one, and rows that differ fail the job.
    """
    others = [c for c in batch.columns if c != id]
    row = F.struct(*others)
    if order:
        chosen = F.max_by(row, F.struct(order, *[c for c in others if c != order]))
    else:
        clash = F.raise_error(F.concat(F.lit("several rows for id "), F.first(id), F.lit(", and no order to choose by")))
        chosen = F.when(F.min(row) == F.max(row), F.max(row)).otherwise(clash.cast(batch.select(row.alias("r")).schema["r"].dataType))
    return batch.groupBy(id).agg(chosen.alias("_row")).select(id, *(F.col(f"_row.{c}").alias(c) for c in others))


def complete(batch: DataFrame, as_of=None) -> DataFrame:
    """Fill in what a client may leave out, in the document layout.

    ``updated_at`` is always the time of the write; a document is embedded
    exactly if it has a non-empty vector.
    """
    for field in DOCUMENT_SCHEMA:
        if field.name not in batch.columns:
            batch = batch.withColumn(field.name, F.lit(None).cast(field.dataType))
    vector = F.when(F.size("vector") > 0, F.col("vector"))
    return batch.withColumns(
        {
            "metadata": F.coalesce("metadata", F.lit("null")),
            "tags": F.coalesce("tags", F.array().cast("array<string>")),
            "vector": vector,
            "created_at": F.coalesce("created_at", _as_of(as_of)),
            "updated_at": _as_of(as_of),
            "is_embedded": vector.isNotNull(),
        }
    ).select(*DOCUMENT_COLUMNS)


def upsert(current: DataFrame, batch: DataFrame, as_of=None, order: str | None = None, unique: bool = False, few: bool = False) -> DataFrame:
    """Insert new ids and replace existing ones.

    Documents without an id get a new one each. A replaced document keeps
    only its ``created_at``; one stored again without a vector loses the old
    vector and is pending again. ``unique`` says that all rows of the batch
    have an id of their own, so that none need be chosen; ``few``, that these
    ids can be sent to all tasks, so that no text is shuffled.
    """
    fresh = complete(batch if unique else latest_per_id(with_ids(batch), order), as_of)
    if unique and few:
        ids = F.broadcast(fresh.select("id"))
        old = current.select("id", F.col("created_at").alias("_created")).join(ids, "id", "left_semi")
        new = fresh.join(F.broadcast(old), "id", "left").withColumn("created_at", F.coalesce("_created", "created_at"))
        return current.join(ids, "id", "left_anti").select(*DOCUMENT_COLUMNS).unionByName(new.select(*DOCUMENT_COLUMNS))
    old = current.select(F.col("id").alias("_id"), F.struct(*DOCUMENT_COLUMNS).alias("_old"))
    both = old.join(fresh.select("id", F.struct(*DOCUMENT_COLUMNS).alias("_new")), F.col("_id") == F.col("id"), "full_outer")
    is_new = F.col("_new").isNotNull()
    columns = {c: F.when(is_new, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) for c in DOCUMENT_COLUMNS}
    columns["created_at"] = F.coalesce("_old.created_at", "_new.created_at")
    return both.select(*(value.alias(name) for name, value in columns.items()))


def delete(current: DataFrame, ids: DataFrame) -> DataFrame:
    """The collection without the given ids."""
    return current.join(ids.select("id").distinct(), "id", "left_anti").select(*current.columns)


def not_found(current: DataFrame, ids: DataFrame) -> DataFrame:
    """The given ids that the collection does not hold."""
    return ids.select("id").distinct().join(current.select("id"), "id", "left_anti")


def update_vectors(current: DataFrame, vectors: DataFrame, as_of=None, order: str | None = None) -> DataFrame:
    """Set the vectors of the given ids (``id, vector``); other fields stay."""
    new = latest_per_id(vectors, order).select("id", F.col("vector").alias("_new"))
    found = F.col("_new").isNotNull()
    return (
        current.join(new, "id", "left")
        .withColumns(
            {
                "vector": F.coalesce("_new", "vector"),
                "updated_at": F.when(found, _as_of(as_of)).otherwise(F.col("updated_at")),
                "is_embedded": found | F.col("is_embedded"),
            }
        )
        .select(*current.columns)
    )
