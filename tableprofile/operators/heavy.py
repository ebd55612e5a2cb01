"""Exact top values from sketches of frequent values, checked by counts.

Counting every value of a text column shuffles every different value of every task. Here a
sketch of each column proposes candidates. A second scan counts the candidates, and adds up
the rows of all other values in a fixed number of buckets: no other value can have more rows
than its bucket. Where the rarest wanted candidate beats every bucket, nothing is missing;
where it does not, a third scan counts the values of the buckets that could hold one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import column as named
from .profile import top_of_counts, with_texts
from .schema import TEXT, bounded_key, fields_of_kind

# Candidates of a column beside the wanted ones, and values that a sketch tracks.
CANDIDATES = 64
TRACKED = 8192
BUCKETS = 4096


def _sketched(keys: DataFrame, candidates: int, tracked: int) -> list[tuple[str, str]]:
    """(column, value): about the most frequent values of each column, from one scan."""
    n = F.lit(candidates), F.lit(max(tracked, candidates))
    sketches = keys.agg(*(F.call_function("approx_top_k", named(c), *n).alias(f"c{i}") for i, c in enumerate(keys.columns))).first()
    return [(c, item["item"]) for c, items in zip(keys.columns, sketches, strict=True) for item in items or [] if item["item"] is not None]


def _long(keys: DataFrame) -> DataFrame:
    return keys.unpivot([], [named(c) for c in keys.columns], "column", "value").where(F.col("value").isNotNull())


def top_values(
    df: DataFrame, k: int = 5, candidates: int = CANDIDATES, tracked: int = TRACKED, buckets: int = BUCKETS
) -> DataFrame:
    """The ``k`` most frequent values of every text column, exactly as ``categorical_top_k`` gives them.

    On skewed columns a task shuffles its candidates and buckets and no other value. Two
    scans run when the plan is built; the source has to give the same rows each time.
    """
    fields = fields_of_kind(df, TEXT)
    keys = df.select(*(bounded_key(named(f.name)).alias(f.name) for f in fields))
    spark = df.sparkSession
    schema = "column string, value string, count long"
    if not fields:
        return top_of_counts(spark.createDataFrame([], schema), k)
    proposed = spark.createDataFrame(_sketched(keys, k + candidates, tracked), "_column string, _value string")
    proposed = F.broadcast(proposed)  # k + candidates rows a column, of at most 64 bytes
    bucket = F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int")
    same = (F.col("column") == F.col("_column")) & (F.col("value") == F.col("_value"))
    other = F.col("_value").isNull()
    counted = (
        _long(keys)
        .join(proposed, same, "left")
        .groupBy("column", F.col("_value").alias("value"), F.when(other, bucket).alias("bucket"))
        .count()
        .collect()  # candidates and buckets: a fixed number a column
    )
    known = [(r["column"], r["value"], r["count"]) for r in counted if r["bucket"] is None]
    least = {}
    for f in fields:
        counts = sorted((n for c, _, n in known if c == f.name), reverse=True)
        least[f.name] = counts[k - 1] if len(counts) >= k else 0
    # A value with as many rows as the last candidate may come before it, so equal is not enough.
    open_ = [(r["column"], r["bucket"]) for r in counted if r["bucket"] is not None and r["count"] >= least[r["column"]]]
    counts = spark.createDataFrame(known, schema)
    if open_:
        doubtful = F.broadcast(spark.createDataFrame(open_, "_c string, _bucket int"))
        in_doubt = _long(keys).join(doubtful, (F.col("column") == F.col("_c")) & (bucket == F.col("_bucket")), "left_semi")
        rest = in_doubt.join(proposed, same, "left_anti").groupBy("column", "value").count()
        counts = counts.unionByName(rest)
    return with_texts(df, top_of_counts(counts, k))
