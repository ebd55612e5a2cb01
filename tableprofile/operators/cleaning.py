"""Cleaning of tables with hand-typed numbers and clock times."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fix_hour, is_missing, locale_decimal, na_to_null, parse_decimal
from ..functions.names import column
from .schema import TEXT, kind_of

# Names, in any case, of the columns that hold numbers to clean, and the
# part of a name that marks a column of clock times.
NUMBER_COLUMNS = {
    "latitude": ("lat", "latitud"),
    "longitude": ("long", "longitud"),
    "age": ("edad",),
}
HOUR_PART = "hora"


def normalise_na(df: DataFrame) -> DataFrame:
    """Null for every NA token in the text columns."""
    return df.withColumns(
        {f.name: na_to_null(column(f.name)) for f in df.schema.fields if kind_of(f.dataType) == TEXT}
    )


def _has_value(df: DataFrame) -> Column:
    return reduce(Column.__or__, (~is_missing(f) for f in df.schema.fields))


def _is_complete(df: DataFrame) -> Column:
    return reduce(Column.__and__, (~is_missing(f) for f in df.schema.fields))


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """Without the rows that hold no value at all; NaN counts as no value."""
    return df.where(_has_value(df))


def drop_any_null_rows(df: DataFrame) -> DataFrame:
    """Without the rows in which any value is missing."""
    return df.where(_is_complete(df))


def _cleaning_role(name: str) -> str | None:
    for role, names in NUMBER_COLUMNS.items():
        if name.lower() in names:
            return role
    return "hour" if HOUR_PART in name.lower() else None


def cleaning_columns(columns: Sequence[str]) -> dict[str, str]:
    """Which columns hold latitude, longitude, age and clock time; the first of each."""
    found: dict[str, str] = {}
    for name in columns:
        if (role := _cleaning_role(name)) is not None:
            found.setdefault(role, name)
    return found


def clean_dataset(df: DataFrame, drop_any: bool = False) -> DataFrame:
    """Drop empty rows, read decimals, repair clock times.

    A narrow plan without a shuffle. Coordinates and age become doubles; to write them
    with a decimal comma, pass the result through ``locale_export``.
    """
    kept = drop_all_null_rows(df)
    if drop_any:
        kept = drop_any_null_rows(kept)
    roles = cleaning_columns(df.columns)
    rewritten = {c: parse_decimal(column(c)) for role, c in roles.items() if role != "hour"}
    if "hour" in roles:
        rewritten[roles["hour"]] = fix_hour(column(roles["hour"]))
    return kept.withColumns(rewritten) if rewritten else kept


def locale_export(df: DataFrame) -> DataFrame:
    """Coordinates and age as text with a decimal comma, for spreadsheet programs."""
    roles = cleaning_columns(df.columns)
    return df.withColumns({c: locale_decimal(column(c)) for role, c in roles.items() if role != "hour"})


def retention_report(df: DataFrame, name: str = "dataset", drop_any: bool = False) -> DataFrame:
    """Rows before and after ``clean_dataset`` and the percentage kept, from one scan."""
    kept = _is_complete(df) if drop_any else _has_value(df)
    return df.agg(F.count("*").alias("initial_rows"), F.count_if(kept).alias("final_rows")).select(
        F.lit(name).alias("dataset"),
        "initial_rows",
        "final_rows",
        F.coalesce(F.try_divide("final_rows", "initial_rows") * 100, F.lit(0.0)).alias("percent"),
    )
