"""Batch ingest of documents sent as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.embed import embed_column
from docloom.operators.mutate import complete, latest_per_id, with_ids

CORRUPT = "_corrupt_record"
ARRIVAL = "arrival"


def _parsed(lines: DataFrame) -> DataFrame:
    """Requests from lines of text. A line that is no JSON object, or whose
    fields are not of the kinds a request has, is kept as a corrupt record.

    ``arrival`` orders requests as they came in, by time, name and block of
    the file; ``to_documents`` adds the place within the block.
    """
    file = [F.col(f"_metadata.{name}") for name in ("file_modification_time", "file_path", "file_block_start")]
    lines = lines.select("value", F.struct(*file).alias(ARRIVAL))
    lines = lines.where(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    kinds = {"id": "STRING", "content": "STRING", "metadata": "OBJECT.*", "tags": "ARRAY.*"}
    fields = {name: F.try_variant_get("_v", f"$.{name}", "variant") for name in kinds}

    def fits(name):
        kind = F.coalesce(F.schema_of_variant(fields[name]), F.lit("VOID"))
        return kind.rlike(f"^({kinds[name]}|VOID)$")

    tags = F.try_variant_get("_v", "$.tags", "array<variant>")
    only_text = F.forall(F.coalesce(tags, F.array().cast("array<variant>")), lambda t: F.coalesce(F.schema_of_variant(t), F.lit("VOID")).isin("STRING", "VOID"))
    is_object = F.coalesce(F.schema_of_variant("_v"), F.lit("")).startswith("OBJECT")
    good = F.coalesce(is_object & fits("id") & fits("content") & fits("metadata") & fits("tags") & only_text, F.lit(False))
    # metadata stays as it was written, so it is cut out of the text
    written = F.get_json_object("value", "$.metadata")
    return lines.select(
        F.when(good, F.try_variant_get("_v", "$.id", "string")).alias("id"),
        F.when(good, F.try_variant_get("_v", "$.content", "string")).alias("content"),
        F.when(good, written).alias("metadata"),
        F.when(good, F.array_compact(F.transform(tags, lambda t: F.try_variant_get(t, "$", "string")))).alias("tags"),
        F.when(~good, F.col("value")).alias(CORRUPT),
        ARRIVAL,
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Ingest records, with the raw text of unreadable ones."""
    return _parsed(spark.read.text(path))


def stream_json(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same records as a stream of arriving files."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _parsed(reader.text(path))


# The reasons as a client knows them.
BAD_BODY, NO_CONTENT = "invalid request body", "content is required"


def _reason(df: DataFrame):
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    return F.when(corrupt, BAD_BODY).when(F.coalesce("content", F.lit("")) == "", NO_CONTENT)


def accepted(records: DataFrame) -> DataFrame:
    """Records that can be stored."""
    return records.where(_reason(records).isNull()).drop(CORRUPT)


def rejected(records: DataFrame) -> DataFrame:
    """Records that cannot, with the reason."""
    return records.withColumn("reason", _reason(records)).where(F.col("reason").isNotNull())


def all_differ(records: DataFrame) -> bool:
    """Has every accepted record an id that no other has, or none? No text is shuffled to see it."""
    ids = accepted(records).select("id").where(F.coalesce("id", F.lit("")) != "")
    return ids.groupBy("id").count().where("count > 1").isEmpty()


def to_documents(
    records: DataFrame, embedder=None, embed: str = "sync", as_of=None, order: str | None = None, unique: bool = False
) -> DataFrame:
    """Accepted records as new documents.

    With an embedder, ``embed`` of ``sync``, ``embed`` or nothing fills the
    vectors in now; any other value, such as ``async``, leaves the documents
    pending for the backfill. Of records with the same id the one with the
    highest ``order`` value is kept, which is the last to arrive for records
    read by this module; without an order they must not differ. ``unique`` says
    that no id repeats, so that none need be chosen.
    """
    docs = with_ids(accepted(records))
    if order is None and ARRIVAL in docs.columns:
        docs = docs.withColumn(ARRIVAL, F.struct(ARRIVAL, F.monotonically_increasing_id()))
        order = ARRIVAL
    docs = (docs if unique else latest_per_id(docs, order)).drop(ARRIVAL)
    if embedder is not None and embed in ("", None, "sync", "embed"):
        docs = embed_column(docs, embedder)
    return complete(docs, as_of)
