"""Samples: quotas, order, independence of partitioning."""

import hashlib

from pyspark.sql import functions as F

from tableprofile.operators import sampling


def _expected(keys, size, seed=42):
    return set(sorted(keys, key=lambda k: (hashlib.md5(f"{k}|{seed}".encode()).hexdigest(), k))[:size])


def _table(spark, n=6000):
    third = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 5).cast("string")))
    return spark.range(n).select("id", third.alias("kind"))


def test_random_sample_is_the_start_of_the_order(spark):
    df = _table(spark)
    for size in (5, 40, 500):
        got = {r["id"] for r in sampling.random_sample(df.repartition(7), "id", size).collect()}
        assert got == _expected(range(6000), size)


def test_stratified_sample_takes_the_quota_of_every_stratum(spark):
    df = _table(spark)
    sample = sampling.stratified_sample(df, "id", size=60).collect()
    kinds = {r["kind"] for r in df.select("kind").distinct().collect()}
    for kind in kinds:
        keys = [r["id"] for r in df.where(F.col("kind") == kind).collect()]
        assert {r["id"] for r in sample if r["kind"] == kind} == _expected(keys, 60 // len(kinds))
    again = sampling.stratified_sample(df.repartition(5), "id", size=60).collect()
    assert set(sample) == set(again)


def test_the_size_is_applied_to_tables_of_any_size(spark):
    for n in (3000, 6000):
        sample = stratified(spark, n)
        assert sample.count() == 60 // 6 * 6
        assert round(sample.agg(F.sum("sample_weight")).first()[0]) == n


def stratified(spark, n):
    return sampling.stratified_sample(_table(spark, n), "id", size=60)


def test_column_names_of_any_kind(spark):
    df = _table(spark, 300).select("id", F.col("kind").alias("a.b"), F.lit(7).alias("_order"), F.lit(8).alias("_rank"), F.lit(9).alias("__slice"))
    sample = sampling.stratified_sample(df, "id", size=30)
    assert sample.columns == [*df.columns, "sample_weight"]
    assert sample.select("_order", "_rank", "__slice").distinct().collect() == [(7, 8, 9)]
    plain = sampling.random_sample(df, "id", 30)
    assert plain.columns == df.columns and plain.select("_order").distinct().collect() == [(7,)]


def test_rows_without_a_category(spark):
    df = _table(spark).withColumn("kind", F.when(F.col("id") % 4 > 0, F.col("kind")))
    assert sampling.stratified_sample(df, "id", size=60).where("kind is null").count() == 0
    assert sampling.stratified_sample(df, "id", size=60, keep_null=True).where("kind is null").count() > 0
    none = df.withColumn("kind", F.lit(None).cast("string"))
    assert {r["id"] for r in sampling.stratified_sample(none, "id", size=50).collect()} == _expected(range(6000), 50)
    numbers = df.select("id")
    assert sampling.stratified_sample(numbers, "id", size=50).count() == 50


def test_more_categories_than_rows_wanted(spark):
    df = spark.range(6000).select("id", (F.col("id") % 800).cast("string").alias("kind"))
    sample = sampling.stratified_sample(df, "id")
    assert sample.count() == sample.select("kind").distinct().count() == 800
    assert sample.agg(F.sum("sample_weight")).first()[0] == 6000


def test_coverage(spark):
    df = _table(spark)
    row = sampling.sample_coverage(df, sampling.random_sample(df, "id", 600)).first()
    assert (row["rows"], row["sample_rows"], row["percent"]) == (6000, 600, 10.0)
