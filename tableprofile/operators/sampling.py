"""Reproducible samples.

The order of a sample comes from the MD5 of a row key and a seed, so the same rows
are drawn on any cluster, whatever the partitioning. The size is always applied, in
the same way for tables of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sample_order
from ..functions.names import column
from .schema import TEXT, fields_of_kind

# Rows of a sample unless told otherwise, and its seed.
SAMPLE_ROWS = 500
SEED = 42

# Ranks are taken within slices of a stratum first, so no task sorts a whole stratum.
SLICES = 32
WEIGHT = "sample_weight"


def _free_prefix(df: DataFrame) -> str:
    """What no column of the table begins with."""
    prefix = "_"
    while any(name.startswith(prefix) for name in df.columns):
        prefix += "_"
    return prefix


def _all_columns(df: DataFrame) -> list[Column]:
    return [column(name) for name in df.columns]


def random_sample(
    df: DataFrame, key: str, size: int = SAMPLE_ROWS, seed: int = SEED, weight: str | None = None
) -> DataFrame:
    """The ``size`` rows that come first in the order of the sample key.

    Each task keeps the first ``size`` rows it meets, so the table is neither sorted nor
    counted. With ``weight``, a column of that name says how many rows of the table a row
    of the sample stands for.
    """
    order = _free_prefix(df) + "order"
    first = df.withColumn(order, sample_order(column(key), seed)).orderBy(order, column(key)).limit(size).drop(order)
    if weight is None:
        return first
    rows = df.agg(F.count("*")).scalar()
    return first.withColumn(weight, rows / F.least(rows, F.lit(size)))


def stratified_sample(
    df: DataFrame,
    key: str,
    category: str | None = None,
    size: int = SAMPLE_ROWS,
    seed: int = SEED,
    keep_null: bool = False,
    weight: str = WEIGHT,
) -> DataFrame:
    """About ``size`` rows, equally many of every category, and at least one of each.

    The category is the first text column unless given; a table without one gives a plain
    random sample. Rows without a category are left out unless ``keep_null`` is set or no
    row has one. ``weight`` says how many rows of its stratum a row stands for. Where there
    are more categories than ``size``, each of them keeps its first row.
    """
    if category is None:
        category = next((f.name for f in fields_of_kind(df, TEXT)), None)
    if category is None:
        return random_sample(df, key, size, seed, weight)

    prefix = _free_prefix(df)
    order, piece, rank, stratum, rows = (prefix + name for name in ("order", "slice", "rank", "stratum", "rows"))
    strata = df.groupBy(column(category).alias(stratum)).agg(F.count("*").alias(rows))
    categories = strata.agg(F.count(stratum)).scalar()
    quota = F.greatest(F.lit(1), F.floor(F.lit(size) / F.greatest(categories, F.lit(1))))
    wanted = F.lit(True) if keep_null else column(category).isNotNull() | (categories == 0)

    # No quota is above the size; as a literal, it lets Spark cut every task's rows per
    # group before each shuffle.
    first = [F.col(order), column(key)]
    in_slice = Window.partitionBy(column(category), F.col(piece)).orderBy(*first)
    in_stratum = Window.partitionBy(column(category)).orderBy(*first)
    drawn = (
        df.where(wanted)
        .withColumn(order, sample_order(column(key), seed))
        .withColumn(piece, F.pmod(F.xxhash64(column(key)), F.lit(SLICES)))
        .withColumn(rank, F.row_number().over(in_slice))
        .where(F.col(rank) <= size)
        .withColumn(rank, F.row_number().over(in_stratum))
        .where(F.col(rank) <= size)
        .where(F.col(rank) <= quota)
    )
    weighed = drawn.join(strata, column(category).eqNullSafe(F.col(stratum)))
    return weighed.select(*_all_columns(df), (F.col(rows) / F.least(quota, F.col(rows))).alias(weight))


def sample_coverage(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Rows of the table and of its sample, and the percentage the sample covers."""
    counts = df.agg(F.count("*").alias("rows")).select("rows", sample.agg(F.count("*")).scalar().alias("sample_rows"))
    return counts.withColumn("percent", F.try_divide("sample_rows", "rows") * 100)
