"""Data quality: duplicates, outliers, issues, score, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import is_missing, value_or_null
from .profile import Quantiles, distinct_counts, null_percent, quartiles
from .schema import NUMERIC, TEXT, column_array, comparable, fields_of_kind, kind_of, per_column

# Fixed values of the quality rules.
IQR_FACTOR = 1.5
LOW_COMPLETENESS = 90.0
HIGH_NULL_PERCENT = 20.0
SCORE_WEIGHTS = {"completeness": 0.5, "duplicates": 0.3, "outliers": 0.2}
GOOD_SCORE, FAIR_SCORE = 80.0, 60.0
FEW_VALUES = 10
ID_LIKE_SHARE = 0.8


def _row_digest(df: DataFrame) -> Column:
    """256 bits of all values of a row: equal exactly for equal rows, as far as SHA-256 tells texts apart.

    Each value enters with its length, so values of neighbouring columns cannot be mixed up.
    """

    def part(f) -> Column:
        c = comparable(f)
        if isinstance(f.dataType, T.TimestampType):
            c = F.unix_micros(c)  # as text, an hour comes twice when clocks go back
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0)  # -0 is 0
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(part(f) for f in df.schema.fields), F.lit("")), 256))


def duplicate_count(df: DataFrame) -> Column:
    """The number of rows beyond the first of their kind, as a scalar.

    One scan and one shuffle of a 32-byte digest per different row of a task: copies meet
    in the map-side combine.
    """
    groups = df.select(_row_digest(df).alias("digest")).groupBy("digest").count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).scalar()


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, and rows beyond the first of their kind."""
    duplicates = duplicate_count(df).alias("duplicates")
    counted = df.agg(F.count("*").alias("rows")).select("rows", duplicates)
    return counted.select("rows", (F.col("rows") - F.col("duplicates")).alias("distinct_rows"), "duplicates")


def _fences(quantiles: Quantiles, column: str) -> tuple[Column, Column]:
    low, _, high = quantiles.get(column, (None, None, None))
    if low is None or high is None:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    reach = IQR_FACTOR * (high - low)
    return F.lit(low - reach), F.lit(high + reach)


def _outside(quantiles: Quantiles, field) -> Column:
    low, high = _fences(quantiles, field.name)
    value = value_or_null(field).cast("double")
    return F.count_if((value < low) | (value > high))


def iqr_outliers(df: DataFrame, quantiles: Quantiles | None = None) -> DataFrame:
    """Numeric columns with values outside the interquartile fences, and how many.

    The fences are constants of the plan, so counting is one scan without a join.
    """
    known = quartiles(df) if quantiles is None else quantiles
    counted = per_column(
        df,
        fields_of_kind(df, NUMERIC),
        {
            "lower_fence": lambda f: _fences(known, f.name)[0],
            "upper_fence": lambda f: _fences(known, f.name)[1],
            "outliers": lambda f: _outside(known, f),
        },
    )
    return counted.where(F.col("outliers") > 0)


def high_null_columns(df: DataFrame, limit: float = HIGH_NULL_PERCENT) -> DataFrame:
    """Columns with more than ``limit`` percent nulls, worst first."""
    return (
        null_percent(df)
        .where(F.col("null_percent") > limit)
        .select("column", F.round("null_percent", 1).alias("null_percent"))
        .orderBy(F.desc("null_percent"), "column")
    )


def outlier_count(field, quantiles: Quantiles) -> Column:
    """How many values lie outside the fences; zero for columns that are not numeric."""
    return _outside(quantiles, field) if kind_of(field.dataType) == NUMERIC else F.lit(0).cast("long")


def quality_of(facts: DataFrame, width: int, numeric: int, *carry: str) -> DataFrame:
    """Add the quality result to a row of facts.

    ``facts`` has ``rows``, ``duplicates`` and ``columns``, an array of structs with
    ``column``, ``nulls`` and ``outliers``. Arithmetic on one row, no further scan.
    """
    rows = F.col("rows")
    nulls = F.aggregate("columns", F.lit(0).cast("long"), lambda total, c: total + c["nulls"])
    with_outliers = F.filter("columns", lambda c: c["outliers"] > 0)
    with_nulls = F.filter(
        F.transform(
            "columns",
            lambda c: F.struct(c["column"].alias("column"), (F.try_divide(c["nulls"], rows) * 100).alias("percent")),
        ),
        lambda c: c["percent"] > HIGH_NULL_PERCENT,
    )
    measured = facts.select(
        *carry,
        rows.alias("total_rows"),
        F.lit(width).cast("long").alias("total_columns"),
        "duplicates",
        F.coalesce(F.try_divide(rows * width - nulls, rows * width) * 100, F.lit(0.0)).alias("_completeness"),
        F.map_from_entries(F.transform(with_outliers, lambda c: F.struct(c["column"], c["outliers"]))).alias("outliers"),
        F.map_from_entries(
            F.transform(with_nulls, lambda c: F.struct(c["column"], F.round(c["percent"], 1)))
        ).alias("high_null_columns"),
    )
    completeness = F.col("_completeness")
    n_outlier_columns, n_null_columns = F.size("outliers"), F.size("high_null_columns")
    penalty = F.least(n_outlier_columns / F.lit(max(numeric, 1)) * 100, F.lit(100.0))
    score = F.round(
        completeness * SCORE_WEIGHTS["completeness"]
        + (100 - F.try_divide("duplicates", "total_rows") * 100) * SCORE_WEIGHTS["duplicates"]
        + (100 - penalty) * SCORE_WEIGHTS["outliers"],
        1,
    )
    band = F.when(score >= GOOD_SCORE, "green").when(score >= FAIR_SCORE, "yellow").when(score.isNotNull(), "red")

    def issue(when: Column, name: str, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("issue"), value.cast("double").alias("value")))

    issues = F.array_compact(
        F.array(
            issue(completeness < LOW_COMPLETENESS, "low_completeness", F.round(completeness, 1)),
            issue(F.col("duplicates") > 0, "duplicate_rows", F.col("duplicates")),
            issue(n_outlier_columns > 0, "outlier_columns", n_outlier_columns),
            issue(n_null_columns > 0, "high_null_columns", n_null_columns),
        )
    )
    return measured.select(
        *carry,
        score.alias("score"),
        band.alias("band"),
        F.round(completeness, 1).alias("completeness"),
        "duplicates",
        "outliers",
        "high_null_columns",
        issues.alias("issues"),
        "total_rows",
        "total_columns",
    )


def quality_record(df: DataFrame, quantiles: Quantiles | None = None) -> DataFrame:
    """The quality result as one row, with maps for the per-column findings.

    One scan counts nulls and outliers of all columns; the duplicate count is a scalar
    subquery. Everything else is arithmetic on that row.
    """
    known = quartiles(df) if quantiles is None else quantiles
    columns = column_array(
        df.schema.fields,
        {"nulls": lambda f: F.count_if(is_missing(f)), "outliers": lambda f: outlier_count(f, known)},
    )
    facts = df.agg(F.count("*").alias("rows"), columns.alias("columns"))
    return quality_of(
        facts.withColumn("duplicates", duplicate_count(df)), len(df.columns), len(fields_of_kind(df, NUMERIC))
    )


def quality_score(df: DataFrame, quantiles: Quantiles | None = None) -> DataFrame:
    """Score and band with the figures they come from; an empty table has no score."""
    return quality_record(df, quantiles).select(
        "score", "band", "completeness", "duplicates", F.size("outliers").cast("long").alias("outlier_columns")
    )


def quality_issues(df: DataFrame, quantiles: Quantiles | None = None) -> DataFrame:
    """One row per problem found, with the figure behind it."""
    return quality_record(df, quantiles).select(F.inline("issues"))


def data_quality(df: DataFrame, quantiles: Quantiles | None = None) -> DataFrame:
    """The quality result in long form: (metric, item, value)."""

    def single(name: str) -> Column:
        return F.struct(
            F.lit(name).alias("metric"), F.lit(None).cast("string").alias("item"), F.col(name).cast("double").alias("value")
        )

    def per_item(name: str) -> Column:
        return F.transform(
            F.map_entries(name),
            lambda e: F.struct(F.lit(name).alias("metric"), e["key"].alias("item"), e["value"].cast("double").alias("value")),
        )

    found = F.transform(
        "issues",
        lambda i: F.struct(F.lit("issue").alias("metric"), i["issue"].alias("item"), i["value"].alias("value")),
    )
    singles = F.array(*(single(n) for n in ("score", "completeness", "duplicates", "total_rows", "total_columns")))
    return quality_record(df, quantiles).select(
        F.inline(F.concat(singles, per_item("outliers"), per_item("high_null_columns"), found))
    )


def _text_cardinality(df: DataFrame, exact: bool) -> DataFrame:
    rows = df.agg(F.count("*")).scalar()
    names = [f.name for f in fields_of_kind(df, TEXT)]
    return distinct_counts(df, names, exact).withColumn("rows", rows)


def low_cardinality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Text columns with few different values, which can be encoded."""
    return _text_cardinality(df, exact).where(F.col("distinct") < FEW_VALUES).select("column", "distinct")


def high_cardinality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Text columns that are different in most rows, probably identifiers."""
    return (
        _text_cardinality(df, exact)
        .where(F.col("distinct") > F.col("rows") * ID_LIKE_SHARE)
        .select("column", "distinct")
    )


def advice_on(low_cardinality: Column, high_cardinality: Column) -> Column:
    """An array of what to do about a table, from the columns of ``quality_of``."""
    rules = [
        ("drop_duplicates", F.col("duplicates") > 0, F.col("duplicates")),
        ("review_high_null_columns", F.size("high_null_columns") > 0, F.size("high_null_columns")),
        ("review_outliers", F.size("outliers") > 0, F.size("outliers")),
        ("deep_clean", F.col("score") < GOOD_SCORE, F.col("score")),
        ("encode_low_cardinality", low_cardinality > 0, low_cardinality),
        ("review_high_cardinality", high_cardinality > 0, high_cardinality),
    ]
    advice = F.array_compact(
        F.array(*(F.when(rule, _advice(i, name, value)) for i, (name, rule, value) in enumerate(rules, 1)))
    )
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(_advice(0, "excellent", F.col("score"))))


def recommendations(df: DataFrame, quantiles: Quantiles | None = None, exact: bool = True) -> DataFrame:
    """(ord, recommendation, value): what to do about the table, or ``excellent``."""
    cardinality = _text_cardinality(df, exact).agg(
        F.struct(
            F.count_if(F.col("distinct") < FEW_VALUES).alias("low"),
            F.count_if(F.col("distinct") > F.col("rows") * ID_LIKE_SHARE).alias("high"),
        )
    )
    facts = quality_record(df, quantiles).select("*", cardinality.scalar().alias("text"))
    return facts.select(F.inline(advice_on(F.col("text.low"), F.col("text.high"))))


def _advice(order: int, name: str, value: Column) -> Column:
    return F.struct(
        F.lit(order).cast("long").alias("ord"), F.lit(name).alias("recommendation"), value.cast("double").alias("value")
    )
