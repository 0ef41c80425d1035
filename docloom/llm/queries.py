"""The registered queries of these operators, over whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.llm import (
    conversation_repair,
    decontaminate,
    license_scan,
    line_dedup,
    mixing,
    near_dedup,
    quality_classifier,
    quality_rules,
    substring_dedup,
    suffix_dedup,
    toxicity,
    warc,
    whitening,
)
from docloom.llm.common import held_out
from docloom.sources.tables import load

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


@query
def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(load(spark, sf_dir, "documents"), with_bytes=False).drop("kept_bytes")


@query
def op4_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op10_toxicity(spark, sf_dir):
    scored = toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op1_quality_classifier(spark, sf_dir):
    scored = quality_classifier.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op2_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(load(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark, sf_dir):
    cut = line_dedup.deduplicate_lines(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5("text").alias("text_md5"))


@query
def op5_mixing(spark, sf_dir):
    return mixing.mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "mix_key", F.md5("text").alias("text_md5"))


@query
def op6_warc(spark, sf_dir):
    return warc.archive_pages(load(spark, sf_dir, "pages")).drop("url")


@query
def op7_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(load(spark, sf_dir, "documents"))


@query
def op11_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeated_words(load(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


@query
def op12_embedding_whitening(spark, sf_dir):
    rows = whitening.whiten(load(spark, sf_dir, "embeddings"))
    entries = rows.select("*", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "entry"))
    return entries.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
        "entry.whitened", "entry.explained", "identity_error",
    )


@query
def op13_conversation_repair(spark, sf_dir):
    conversations = load(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damage(conversations), conversations)
