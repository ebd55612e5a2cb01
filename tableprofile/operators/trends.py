"""Counts over time, and points on a map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import month_label, parse_decimal, parse_timestamp
from ..functions.dates import DATE_FORMATS
from ..functions.names import column as named
from .schema import TEXT, kind_of


def moment(df: DataFrame, column: str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The column as a timestamp; text is parsed, and unreadable text is null."""
    c = named(column)
    return parse_timestamp(c, formats) if kind_of(df.schema[column].dataType) == TEXT else c


def parse_dates(df: DataFrame, column: str, into: str, formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Add the parsed date of a text column."""
    return df.withColumn(into, moment(df, column, formats))


def _count_by(df: DataFrame, label: Column, name: str) -> DataFrame:
    return df.select(label.alias(name)).where(F.col(name).isNotNull()).groupBy(name).count().orderBy(name)


def count_by_year(df: DataFrame, column: str) -> DataFrame:
    """Rows per year, oldest first; rows without a readable date are left out."""
    return _count_by(df, F.year(moment(df, column)).cast("long"), "year")


def count_by_month(df: DataFrame, column: str) -> DataFrame:
    """Rows per month (``YYYY-MM``), oldest first; months without rows are absent."""
    return _count_by(df, month_label(moment(df, column)), "month")


def _on_earth() -> Column:
    return F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)


def _coordinates(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    return df.select(parse_decimal(named(latitude)).alias("lat"), parse_decimal(named(longitude)).alias("lon"))


def valid_points(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """Readable coordinates within the range of latitudes and longitudes."""
    return _coordinates(df, latitude, longitude).where(_on_earth())


def points_coverage(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """How many of all rows have a valid point, from one scan."""
    return _coordinates(df, latitude, longitude).agg(
        F.count_if(_on_earth()).alias("valid_points"), F.count("*").alias("rows")
    )
