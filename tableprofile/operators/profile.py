"""Column profiles: shape, types, nulls, distinct values, statistics, frequencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import is_missing, value_or_null
from ..functions.names import column as named
from ..functions.text import title_case
from .quantiles import approximate_quantiles, exact_quantiles
from .schema import DIGEST_BYTES, NUMERIC, TEXT, bounded_key, comparable, fields_of_kind, kind_of, per_column, schema_rows

QUARTILES = (0.25, 0.5, 0.75)

Quantiles = Mapping[str, Sequence[float | None]]


def quartiles(df: DataFrame, exact: bool = True) -> Quantiles:
    """25 %, 50 % and 75 % of every numeric column, to be shared by several operators."""
    find = exact_quantiles if exact else approximate_quantiles
    return find(df, fields_of_kind(df, NUMERIC), QUARTILES)


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


# Shape and schema -----------------------------------------------------------


def table_shape(df: DataFrame) -> DataFrame:
    """One row: rows, columns, cells."""
    width = F.lit(len(df.columns)).cast("long")
    return df.agg(F.count("*").alias("rows")).select("rows", width.alias("columns"), (F.col("rows") * width).alias("cells"))


def column_types(df: DataFrame) -> DataFrame:
    """One row per column kind: the columns of the kind and how many values they hold."""
    filled = per_column(df, df.schema.fields, {"values": lambda f: F.count_if(~is_missing(f))})
    order = F.struct(F.col("position"), F.col("column"))
    return (
        schema_rows(df)
        .join(filled, "column")
        .groupBy("kind")
        .agg(
            F.count("*").alias("n_columns"),
            F.concat_ws(",", F.transform(F.array_sort(F.collect_list(order)), lambda s: s["column"])).alias("columns"),
            F.sum("values").alias("values"),
        )
    )


def head_rows(df: DataFrame, n: int, *order_by: str) -> DataFrame:
    """The first ``n`` rows in the given order."""
    return df.orderBy(*order_by).limit(n)


# Nulls ----------------------------------------------------------------------


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, cells, null cells and the percentage of cells that hold a value."""
    width = len(df.columns)
    nulls = sum((F.count_if(is_missing(f)) for f in df.schema.fields), start=F.lit(0))
    counted = df.agg(F.count("*").alias("rows"), nulls.cast("long").alias("null_cells"))
    cells = F.col("rows") * width
    return counted.select(
        "rows",
        cells.alias("cells"),
        "null_cells",
        F.coalesce(_percent(cells - F.col("null_cells"), cells), F.lit(0.0)).alias("completeness"),
    )


def null_percent(df: DataFrame) -> DataFrame:
    """One row per column: null count and percentage."""
    return per_column(
        df,
        df.schema.fields,
        {
            "nulls": lambda f: F.count_if(is_missing(f)),
            "null_percent": lambda f: _percent(F.count_if(is_missing(f)), F.count("*")),
        },
    )


# Distinct values and frequencies -------------------------------------------


def _value_families(df: DataFrame, fields: Sequence[T.StructField]) -> list[DataFrame]:
    """Long form (column, value) of the fields, one frame per value type.

    Grouping numbers and times as such is much cheaper than grouping their text.
    """
    families: dict[str, list[T.StructField]] = {}
    for f in fields:
        if isinstance(f.dataType, T.IntegralType):
            family = "bigint"
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            family = "double"
        elif isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            family = f.dataType.simpleString()
        else:
            family = "string"
        families.setdefault(family, []).append(f)
    return [
        df.select(*(comparable(f).cast(family).alias(f.name) for f in members)).unpivot(
            [], [named(f.name) for f in members], "column", "value"
        )
        for family, members in families.items()
    ]


def distinct_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    exact: bool = True,
    text_counts: DataFrame | None = None,
) -> DataFrame:
    """One row per column: how many different non-null values it holds.

    Exact counts shuffle every distinct value once, after a map-side combine, and long
    text only as a digest. ``exact=False`` takes HyperLogLog sketches from one scan and
    shuffles no values. ``text_counts``, the ``column_value_counts`` of the text columns,
    is used for those where it is needed anyway.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if not exact:
        return per_column(df, fields, {"distinct": lambda f: F.approx_count_distinct(comparable(f))})
    if not fields:
        return per_column(df, fields, {"distinct": lambda f: F.count("*")})
    grouped = [f for f in fields if text_counts is None or kind_of(f.dataType) != TEXT]
    counted = [
        long.groupBy("column", "value").count().groupBy("column").agg(F.count("value").alias("distinct"))
        for long in _value_families(df, grouped)
    ]
    if text_counts is not None:
        # Using the count keeps the grouping the same as that of the top values, so that
        # Spark shuffles once for both.
        counted.append(text_counts.groupBy("column").agg(F.count_if(F.col("count") > 0).alias("distinct")))
    found = counted[0]
    for other in counted[1:]:
        found = found.union(other)
    # An empty table has no groups, yet every column has a count.
    names = schema_rows(df.select(*(named(f.name) for f in fields))).select("column")
    return names.join(found, "column", "left").select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def column_value_counts(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(column, value, count) of text columns, nulls left out, from one scan and one shuffle.

    ``value`` is the ``bounded_key`` of the text, so no long text is shuffled.
    """
    return (
        df.select(*(bounded_key(named(f.name)).alias(f.name) for f in fields))
        .unpivot([], [named(f.name) for f in fields], "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .count()
    )


def _empty_counts(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column string, value string, count long")


def text_value_counts(df: DataFrame) -> DataFrame:
    """``column_value_counts`` of all text columns."""
    fields = fields_of_kind(df, TEXT)
    return column_value_counts(df, fields) if fields else _empty_counts(df)


def categorical_top_k(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of every text column; ties in the order of their bounded keys."""
    return with_texts(df, top_of_counts(text_value_counts(df), k))


def top_of_counts(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column of ``column_value_counts``."""
    # A literal limit lets Spark cut each task's rows to ``k`` per column before the shuffle.
    best = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_texts(df: DataFrame, top: DataFrame) -> DataFrame:
    """``top`` (column, value, ...) with the texts that digests in ``value`` stand for.

    A scan of the long texts, joined with the few rows of ``top``: of the texts themselves,
    only those of the result are shuffled.
    """
    fields = fields_of_kind(df, TEXT)
    if not fields:
        return top
    digests = top.where(F.octet_length("value") >= DIGEST_BYTES).select(F.col("column").alias("_column"), F.col("value").alias("_key"))
    texts = (
        df.select(*(F.when(F.octet_length(named(f.name)) >= DIGEST_BYTES, named(f.name)).alias(f.name) for f in fields))
        .unpivot([], [named(f.name) for f in fields], "_column", "_text")
        .where(F.col("_text").isNotNull())
        .withColumn("_key", bounded_key(F.col("_text")))
        .join(F.broadcast(digests), ["_column", "_key"])  # k rows a column at most
        .groupBy("_column", "_key")
        .agg(F.min("_text").alias("_text"))
    )
    same = (F.col("column") == F.col("_column")) & (F.col("value") == F.col("_key"))
    return top.join(texts, same, "left").withColumn("value", F.coalesce("_text", "value")).select(*top.columns)


def categorical_share(df: DataFrame, k: int = 5, bar_percent: float = 2.0) -> DataFrame:
    """``categorical_top_k`` with each value's share of the column's non-null values."""
    fields = fields_of_kind(df, TEXT)
    filled = per_column(df, fields, {"filled": lambda f: F.count(named(f.name))})
    share = _percent(F.col("count"), F.col("filled"))
    return (
        categorical_top_k(df, k)
        .join(filled, "column")
        .select("column", "rank", "value", "count", share.alias("share"), F.floor(share / bar_percent).alias("bar_length"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of one column, nulls left out, most frequent first."""
    return (
        df.select(named(column).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .count()
        .orderBy(F.desc("count"), "value")
    )


def top_k(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of one column."""
    return value_counts(df, column).limit(k)


def mode_with_count(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value of a text column, how often it occurs, and its label."""
    return top_k(df, column, 1).select("value", title_case(F.col("value")).alias("label"), "count")


def column_detail(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: type, null %, distinct values, cardinality %."""
    facts = per_column(
        df,
        df.schema.fields,
        {
            "rows": lambda f: F.count("*"),
            "null_percent": lambda f: _percent(F.count_if(is_missing(f)), F.count("*")),
        },
    )
    return (
        schema_rows(df)
        .join(facts, "column")
        .join(distinct_counts(df, exact=exact), "column")
        .select(
            "column",
            "position",
            "dtype",
            "kind",
            "null_percent",
            "distinct",
            F.coalesce(_percent(F.col("distinct"), F.col("rows")), F.lit(0.0)).alias("cardinality"),
        )
    )


# Numeric statistics ---------------------------------------------------------


def _known(quantiles: Quantiles, at: int):
    return lambda f: F.lit(quantiles[f.name][at] if f.name in quantiles else None).cast("double")


def _double(f: T.StructField) -> Column:
    return value_or_null(f).cast("double")


def numeric_stats(df: DataFrame, quantiles: Quantiles | None = None) -> DataFrame:
    """Minimum, maximum, mean, median and range of every numeric column."""
    quantiles = quartiles(df) if quantiles is None else quantiles
    stats = per_column(
        df,
        fields_of_kind(df, NUMERIC),
        {
            "min": lambda f: F.min(_double(f)),
            "max": lambda f: F.max(_double(f)),
            "mean": lambda f: F.avg(_double(f)),
            "median": _known(quantiles, 1),
        },
    )
    return stats.withColumn("range", F.col("max") - F.col("min"))


def describe_numeric(df: DataFrame, quantiles: Quantiles | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of every numeric column."""
    quantiles = quartiles(df) if quantiles is None else quantiles
    return per_column(
        df,
        fields_of_kind(df, NUMERIC),
        {
            "count": lambda f: F.count(_double(f)),
            "mean": lambda f: F.avg(_double(f)),
            "std": lambda f: F.stddev_samp(_double(f)),
            "min": lambda f: F.min(_double(f)),
            "p25": _known(quantiles, 0),
            "p50": _known(quantiles, 1),
            "p75": _known(quantiles, 2),
            "max": lambda f: F.max(_double(f)),
        },
    )


# Sizes ----------------------------------------------------------------------

# Bytes of one value of a fixed-width type.
FIXED_WIDTH = {
    T.BooleanType: 1,
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DecimalType: 16,
}


def data_bytes(f: T.StructField) -> Column:
    c, data_type = named(f.name), f.dataType
    width = FIXED_WIDTH.get(type(data_type))
    if width is not None:
        return F.count("*") * width
    if isinstance(data_type, T.ArrayType) and type(data_type.elementType) in FIXED_WIDTH:
        size = F.when(c.isNotNull(), F.size(c)) * FIXED_WIDTH[type(data_type.elementType)]
    elif isinstance(data_type, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    else:
        size = F.octet_length(F.to_json(F.struct(c)))
    return F.coalesce(F.sum(size.cast("long")), F.lit(0))


def column_bytes(df: DataFrame) -> DataFrame:
    """Bytes of data per column: width times rows, or the length of text."""
    sized = per_column(df, df.schema.fields, {"bytes": lambda f: data_bytes(f).cast("long")})
    return sized.withColumn("megabytes", F.col("bytes") / F.lit(float(1024**2)))


# Combined views -------------------------------------------------------------


def _items(df: DataFrame, keep: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long form (keep..., metric, value) of numeric result columns."""
    return df.select(*keep, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(
        list(keep), list(values), "metric", "value"
    )


def column_panel(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """One column's panel: distinct and null counts, then top values or a description."""
    one = df.select(named(column))
    field = one.schema.fields[0]
    dtype = F.lit(field.dataType.simpleString())
    summary = _items(
        distinct_counts(one).join(null_percent(one), "column"), ["column"], ["distinct", "nulls"]
    ).select(F.lit("summary").alias("section"), F.col("metric").alias("item"), "value", dtype.alias("dtype"))
    if kind_of(field.dataType) == NUMERIC:
        body = _items(
            describe_numeric(one), ["column"], ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
        ).select(F.lit("describe"), "metric", "value", dtype)
    else:
        body = top_k(one, column, k).select(
            F.lit("top"), F.col("value").cast("string"), F.col("count").cast("double"), dtype
        )
    return summary.union(body)
