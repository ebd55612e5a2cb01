"""The document pipeline: quality, language, exact copies, near copies, packing.

Each stage takes what its predecessor kept and returns it without what the stage rejects;
the last one returns where each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprofile.llm import exact_dedup, language_id, ngram_join, packing, quality
from tableprofile.llm.common import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with text in a known language."""
    return language_id.keep_clear(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, the one with the largest id; of its repeated rows, one."""
    found = exact_dedup.exact_dedup(docs).where("kept").select(
        F.col("doc_id").alias("_doc_id"), F.col("text_sha256").alias("_sha")
    )
    hashed = docs.withColumn("_text_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_text_sha") == F.col("_sha"))
    return hashed.join(found, same, "left_semi").dropDuplicates(["doc_id", "_text_sha"]).select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by similar five-word shingles, the one with the smallest id.

    Of several rows with one id, or without an id (they come last), the one with the smallest
    text digest: each text of an id is a document here, as in the stage before.
    """
    unclear = F.col("doc_id").isNull() | (F.col("count") > 1)
    if docs.groupBy("doc_id").count().where(unclear).isEmpty():
        found = ngram_join.ngram_join(docs, words=5, percent=80)
        # Usually few rows, so that the texts need not be moved to leave them out.
        dropped = stored(found.where("doc_id != component_id").select("doc_id"), "near-copies")
        return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
    hashed = docs.withColumn("_text_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    names = hashed.select(F.col("doc_id").alias("_doc_id"), F.col("_text_sha").alias("_sha")).distinct()
    # Rising along the sorted rows.
    keys = names.orderBy(F.asc_nulls_last("_doc_id"), "_sha").withColumn("_key", F.monotonically_increasing_id())
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_text_sha") == F.col("_sha"))
    rows = stored(hashed.join(stored(keys, "row-keys"), same).select(*docs.columns, "_key"), "keyed-rows")
    found = ngram_join.ngram_join(rows, words=5, percent=80, doc="_key")
    dropped = stored(found.where("doc_id != component_id").select(F.col("doc_id").alias("_key")), "near-copies")
    return rows.join(dropped, "_key", "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and position for each document."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", clear_language),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("packing", packed),
]

# Trained models decide which documents stay: SQL cannot say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
