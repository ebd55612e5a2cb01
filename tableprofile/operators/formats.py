"""Formats of text columns by the evidence of all their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import column as named
from .schema import TEXT, column_array, fields_of_kind

# Formats that are tried, the first of equally good ones being taken.
DATE_CANDIDATES = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss[.SSS]",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "yyyy/MM/dd",
)
# Conventions of numbers: the decimal mark, and the mark between groups of three digits.
DECIMAL_MARKS = {"1,234.5": (".", ","), "1.234,5": (",", ".")}
MIN_SHARE = 0.5
DATE, DECIMAL, UNKNOWN = "date", "decimal", "text"


def read_decimal(c: Column, convention: str) -> Column:
    """Text as a double by one of ``DECIMAL_MARKS``; null if it does not fit."""
    mark, group = DECIMAL_MARKS[convention]
    pattern = rf"^[+-]?([0-9]+|[0-9]{{1,3}}([{group}][0-9]{{3}})+)([{mark}][0-9]+)?$"
    text = F.trim(c)
    plain = F.replace(F.replace(text, F.lit(group), F.lit("")), F.lit(mark), F.lit("."))
    return F.when(text.rlike(pattern), plain.try_cast("double"))


def _read(c: Column, kind: str, form: str) -> Column:
    return F.try_to_timestamp(F.trim(c), F.lit(form)) if kind == DATE else read_decimal(c, form)


def inferred_formats(df: DataFrame, dates: Sequence[str] = DATE_CANDIDATES, min_share: float = MIN_SHARE) -> DataFrame:
    """(column, kind, format, fits, values, misfits): for each text column the format that most of its values fit.

    One scan scores every candidate for every column, one row a task. A date format or a
    decimal convention that fewer than ``min_share`` of the values fit is none: the column
    is text, and all its values are misfits of no format. Nulls are no values; of equally
    good candidates the first is taken, dates before decimals.
    """
    fields = fields_of_kind(df, TEXT)
    candidates = [(DATE, f) for f in dates] + [(DECIMAL, f) for f in DECIMAL_MARKS]
    if not fields:
        return df.sparkSession.createDataFrame([], "column string, kind string, format string, fits long, values long, misfits long")

    def scores(f) -> Column:
        return F.array(
            *(
                F.struct(F.count(_read(named(f.name), kind, form)).alias("fits"), F.lit(-i).alias("order"), F.lit(kind).alias("kind"), F.lit(form).alias("format"))
                for i, (kind, form) in enumerate(candidates)
            )
        )

    scored = df.agg(column_array(fields, {"scores": scores, "values": lambda f: F.count(named(f.name))}).alias("rows"))
    best = scored.select(F.inline("rows")).select("column", "values", F.array_max("scores").alias("best"))
    good = (F.col("best.fits") > 0) & (F.col("best.fits") >= F.col("values") * F.lit(min_share))
    fits = F.when(good, F.col("best.fits")).otherwise(0)
    return best.select(
        "column",
        F.when(good, F.col("best.kind")).otherwise(UNKNOWN).alias("kind"),
        F.when(good, F.col("best.format")).alias("format"),
        fits.cast("long").alias("fits"),
        "values",
        F.when(good, F.col("values") - fits).otherwise(0).cast("long").alias("misfits"),
    )


def read_by_formats(df: DataFrame, formats: DataFrame) -> DataFrame:
    """``df`` with its text columns as timestamps and doubles by ``inferred_formats``; misfits are null.

    The formats, one row a text column, are known when the plan is built; reading is narrow.
    """
    known = {r["column"]: (r["kind"], r["format"]) for r in formats.where(F.col("format").isNotNull()).collect()}
    return df.select(*(_read(named(c), *known[c]).alias(c) if c in known else named(c) for c in df.columns))
