"""Dates kept as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "dd/MM/yyyy")


def parse_timestamp(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first of ``formats`` that reads the text; null when none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def month_label(ts: Column) -> Column:
    """``YYYY-MM`` of a timestamp."""
    return F.date_format(ts, "yyyy-MM")
