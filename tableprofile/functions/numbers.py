"""Numbers written with a decimal comma or a decimal point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number between spaces. Spark's own cast also takes Java suffixes
# ("1.5d"), so the text is checked before it is cast; the cast drops the spaces.
NUMBER_PATTERN = r"^\s*[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"


def parse_decimal(c: Column) -> Column:
    """Read text as a double, taking ``,`` as the decimal mark; null if unreadable.

    A thousands point next to a decimal comma ("1.234,5") has two marks and is null.
    """
    plain = F.replace(c.cast("string"), F.lit(","), F.lit("."))
    return F.when(plain.rlike(NUMBER_PATTERN), plain.try_cast("double"))


def locale_decimal(c: Column) -> Column:
    """Write a number as text with a decimal comma, for export only."""
    return F.replace(c.cast("string"), F.lit("."), F.lit(","))
