"""The test tables in the layout of a document collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import spread

FIRST_DAY = 1_704_067_200  # 2024-01-01 00:00:00 UTC; document n is n minutes later


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, content, lang, source`` of all documents."""
    documents = load(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), "lang", "source"
    )
    return spread(documents, "id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vector`` of all embeddings."""
    embeddings = load(spark, sf_dir, "embeddings")
    return embeddings.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))


def collection(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    """The documents as a collection: labels become tags and metadata, the
    embedding of the same number becomes the vector."""
    documents = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_label")
    docs = spread(documents, "doc_id").join(labels, F.col("doc_id") == F.col("_label"), "left")
    if with_vectors:
        docs = docs.join(load(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    else:
        docs = docs.withColumn("embedding", F.lit(None).cast("array<float>"))
    extra = [F.when(F.col("quality") == 1, "hq"), F.when(F.col("toxic") == 1, "toxic")]
    metadata = F.concat(
        F.lit('{"source":"'), "source", F.lit('","lang":"'), "lang", F.lit('","n_chars":'), F.col("n_chars").cast("string"),
        F.lit(',"labeled":'), F.col("_label").isNotNull().cast("string"),
        F.lit(',"stats":{"quality":'), F.coalesce(F.col("quality").cast("string"), F.lit("null")), F.lit("}}"),
    )
    created = F.timestamp_seconds(F.col("doc_id") * 60 + FIRST_DAY)
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("content"),
        metadata.alias("metadata"),
        F.array_compact(F.array("lang", "source", *extra)).alias("tags"),
        F.col("embedding").alias("vector"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.col("embedding").isNotNull().alias("is_embedded"),
    )
