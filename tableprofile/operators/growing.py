"""Profiles of tables that grow: one stored per partition, and merged for the whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import is_missing, value_or_null
from .profile import data_bytes
from .schema import NUMERIC, column_array, comparable, kind_of

# Sizes of the sketches: distinct counts within about 1 %, quantiles within 0.5 % of the rows.
DISTINCT_BITS = 14
RANK_SIZE = 800


def partial_profiles(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., column, position, dtype, facts and sketches): one row per partition and column, from one scan.

    Counts, bytes, extremes and moments are exact and additive. The sketches of distinct
    values and of quantiles are mergeable binaries; a task shuffles one row a partition.
    """
    fields = [f for f in df.schema.fields if f.name not in by]
    position = {f.name: i for i, f in enumerate(fields)}

    def number(make):
        """An aggregate of the numbers of a numeric column, and null for others."""

        def of(f: T.StructField) -> Column:
            if kind_of(f.dataType) != NUMERIC:
                return F.lit(None)
            return make(value_or_null(f).cast("double") + F.lit(0.0))

        return of

    metrics = {
        "position": lambda f: F.lit(position[f.name]).cast("long"),
        "dtype": lambda f: F.lit(f.dataType.simpleString()),
        "rows": lambda f: F.count("*"),
        "nulls": lambda f: F.count_if(is_missing(f)),
        "bytes": lambda f: data_bytes(f).cast("long"),
        "low": lambda f: number(F.min)(f).cast("double"),
        "high": lambda f: number(F.max)(f).cast("double"),
        "mean": lambda f: number(F.avg)(f).cast("double"),
        # The sum of squared distances from the mean.
        "spread": lambda f: number(lambda v: F.var_pop(v) * F.count(v))(f).cast("double"),
        "distinct_sketch": lambda f: F.hll_sketch_agg(comparable(f).cast("string"), F.lit(DISTINCT_BITS)),
        "rank_sketch": lambda f: number(lambda v: F.kll_sketch_agg_double(v, RANK_SIZE))(f).cast("binary"),
    }
    grouped = df.groupBy(*by).agg(column_array(fields, metrics).alias("_columns"))
    return grouped.select(*by, F.inline("_columns"))


def store_profiles(df: DataFrame, path: str, by: Sequence[str]) -> str:
    """Profile the partitions that ``df`` holds and put them in the place of what was stored of these.

    ``df`` is the new part of a table, or partitions of it that changed, each as a whole.
    Other partitions are neither read nor written.
    """
    profiles = partial_profiles(df, by)
    profiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return path


def forget_partitions(spark: SparkSession, path: str, condition: Column) -> None:
    """Remove the stored profiles of the partitions that fulfil a condition on their keys."""
    files = spark.read.parquet(path).where(condition).select(F.col("_metadata.file_path").alias("file"))
    folders = files.select(F.regexp_extract("file", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    hadoop = spark._jvm.org.apache.hadoop.fs
    for row in folders.toLocalIterator():
        folder = hadoop.Path(spark._jvm.java.net.URI(row["folder"]))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def merged_profile(partials: DataFrame) -> DataFrame:
    """(column, dtype, rows, nulls, null_percent, bytes, min, max, mean, std, distinct, p25, p50, p75).

    ``partials`` holds stored profiles of any partitions of a table, each once. All but
    ``distinct`` and the quartiles are exact.
    """
    n = F.col("rows") - F.col("nulls")
    totals = partials.groupBy("column").agg(
        F.max_by("position", "rows").alias("position"),
        F.max_by("dtype", "rows").alias("dtype"),
        *(F.sum(c).alias(c) for c in ("rows", "nulls", "bytes")),
        F.min("low").alias("min"),
        F.max("high").alias("max"),
        F.try_divide(F.sum(n * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), n))).alias("mean"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct"),
        F.kll_merge_agg_double("rank_sketch").alias("_ranks"),
    )
    # Around the mean of all: what each partition spreads by itself, and its mean's distance.
    centres = totals.select("column", F.col("mean").alias("_centre"))
    away = F.col("mean") - F.col("_centre")
    spread = partials.join(F.broadcast(centres), "column").groupBy("column").agg(F.sum(F.col("spread") + n * away * away).alias("_spread"))
    degrees = F.col("rows") - F.col("nulls") - 1
    filled = F.col("min").isNotNull()
    quartiles = [F.when(filled, F.kll_sketch_get_quantile_double("_ranks", F.lit(p))).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return totals.join(spread, "column").select(
        "column",
        "position",
        "dtype",
        "rows",
        "nulls",
        (F.try_divide(F.col("nulls"), F.col("rows")) * 100).alias("null_percent"),
        "bytes",
        "min",
        "max",
        "mean",
        F.sqrt(F.when(degrees > 0, F.col("_spread") / degrees)).alias("std"),
        "distinct",
        *quartiles,
    )
