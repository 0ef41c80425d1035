"""The corpus pipeline: five stages over ``documents``.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns what stays; its result is written as Parquet and read again as the
next stage's ``docs``. Null ids and texts pass through where a stage has
nothing to say about them; each operator's docstring has the details.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import fresh, stage
from docloom.llm.decontaminate import contamination
from docloom.llm.line_dedup import deduplicate_lines
from docloom.llm.mixing import mix_sources
from docloom.llm.near_dedup import near_duplicates
from docloom.llm.toxicity import remove_toxic
from docloom.sources.tables import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores 0.5 or more go. Labels are those of ``labels`` that are not held out."""
    return remove_toxic(docs, load(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go from all but their first document. A document
    with no word left goes too; one that never had a word stays."""
    cut = deduplicate_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return cut.where(left).withColumn("n_chars", n_chars).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id
    stays. Rows that repeat id and text count once; rows without an id stay."""
    judged = near_duplicates(docs).where("kept").select("doc_id").distinct()
    chosen = docs.join(judged, "doc_id", "left_semi")
    repeat = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("source"))
    (nth,) = fresh(docs, "_nth")
    once = chosen.withColumn(nth, repeat).where(F.col(nth) == 1)
    return once.select(docs.columns).union(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten words in a row of a benchmark item (or all of a shorter one) go."""
    (key,) = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    hit = contamination(keyed, load(spark, sf_dir, "benchmark"), id_col=key).where("n_hit > 0")
    return keyed.join(hit.select(key).distinct(), key, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources to equal weight, as many documents as came in; ``copy`` and ``mix_key`` are added."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: Toxicity scores and the near-duplicate groups are not for SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
