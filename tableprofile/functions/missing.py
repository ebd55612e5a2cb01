"""What counts as a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import column

# The text tokens that a table reader takes as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def na_to_null(c: Column) -> Column:
    """Null where a text column holds one of the NA tokens."""
    return F.when(~c.isin(*NA_TOKENS), c)


def value_or_null(field: T.StructField) -> Column:
    """The column of ``field``, with NaN read as null."""
    c = column(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def is_missing(field: T.StructField) -> Column:
    """True for null and, in floating-point columns, for NaN."""
    c = column(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()
