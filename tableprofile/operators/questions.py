"""The standard questions about an incident table, as queries with parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fix_hour, parse_decimal
from ..functions.names import column as named
from .profile import top_k, value_counts
from .trends import moment


def most_frequent(df: DataFrame, column: str, k: int = 1) -> DataFrame:
    """Type, shift, cause or gender with the most incidents."""
    return top_k(df, column, k)


def by_zone(df: DataFrame, zone: str = "zona") -> DataFrame:
    """Incidents per zone."""
    return value_counts(df, zone)


def type_in_year(df: DataFrame, type_column: str, wanted: str, date_column: str, year: int) -> DataFrame:
    """How many incidents of one type happened in one year."""
    hit = (named(type_column) == wanted) & (F.year(moment(df, date_column)) == year)
    return df.where(hit).agg(F.count("*").alias("count"))


def risk_hour(df: DataFrame, hour_column: str = "hora") -> DataFrame:
    """The hour of the day with the most incidents."""
    return top_k(df.select(F.substring(fix_hour(named(hour_column)), 1, 2).alias("hour")), "hour", 1)


def mean_age(df: DataFrame, age_column: str = "edad") -> DataFrame:
    """Mean age and the number of rows with a readable age."""
    age = parse_decimal(named(age_column))
    return df.agg(F.avg(age).alias("mean_age"), F.count(age).alias("ages"))


def age_groups(df: DataFrame, age_column: str = "edad", width: int = 10) -> DataFrame:
    """Incidents per age group, largest group first; a group is named by its lowest age."""
    group = F.floor(parse_decimal(named(age_column)) / width) * width
    return value_counts(df.select(group.cast("long").alias("age_group")), "age_group")


def type_share(df: DataFrame, type_column: str, wanted: str) -> DataFrame:
    """Count and percentage of one type among all incidents with a type."""
    counted = df.agg(F.count_if(named(type_column) == wanted).alias("count"), F.count(named(type_column)).alias("total"))
    return counted.withColumn("share", F.try_divide("count", "total") * 100)


def top_cause_in_zone(df: DataFrame, zone: str, cause_column: str = "hipotesis", zone_column: str = "zona") -> DataFrame:
    """The most frequent cause within one zone."""
    return top_k(df.where(named(zone_column) == zone), cause_column, 1)
