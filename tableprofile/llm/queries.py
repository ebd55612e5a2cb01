"""The registered queries of this folder, each with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_pairs,
    exact_dedup,
    hard_negatives,
    language_id,
    language_model,
    nearest,
    ngram_join,
    packing,
    prefix_trie,
    quality,
    substring_dedup,
    token_files,
    url_filter,
)

Build = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _read(spark, folder, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", url_filter.fetched_at(F.col("page_id")))
    return url_filter.filter_urls(captures, url_filter.list_entries(pages))


def op2_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_pairs.encode_and_decode(_read(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
    return found.drop("ids")


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest_neighbours(_read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, folder, "documents"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    definition = public_tokenizers.path("byte_bpe_50k.json")
    files = token_files.write_tokens(_read(spark, folder, "documents"), definition)
    return token_files.read_tokens(files, with_ids=False).drop("ids")


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_join(_read(spark, folder, "documents"), words=3, percent=90)


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.label_languages(_read(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(_read(spark, folder, "documents"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _read(spark, folder, "embeddings")
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, hard_negatives.contract_label())


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.remove_repeats(_read(spark, folder, "documents"), with_text=False)
    return found.drop("repeats", "kept")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(_read(spark, folder, "conversations"))


def builders() -> dict[str, Build]:
    operators = (
        op1_url_filter,
        op2_byte_pairs,
        op3_nearest,
        op4_exact_dedup,
        op5_packing,
        op6_token_files,
        op7_ngram_join,
        op8_language_id,
        op9_quality,
        op10_language_model,
        op11_hard_negatives,
        op12_substring_dedup,
        op13_prefix_trie,
    )
    return {f.__name__: f for f in operators}


def oracles() -> dict[str, str]:
    return {
        "op1_url_filter": url_filter.SQL,
        "op4_exact_dedup": exact_dedup.SQL,
        "op5_packing": packing.sql(),
        "op11_hard_negatives": hard_negatives.SQL,
        "op12_substring_dedup": substring_dedup.SQL,
        "op13_prefix_trie": prefix_trie.SQL,
    }
