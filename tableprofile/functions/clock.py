"""Clock times typed by hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_whitespace

# Two integers around one mark, from 0:00 to 23:59. They may have leading zeros, a
# sign and spaces, as integers may have.
CLOCK_PATTERN = r"^\s*([+]?0*(1?[0-9]|2[0-3])|-0+)\s*:\s*([+]?0*[1-5]?[0-9]|-0+)\s*$"
CLEAN_PATTERN = r"^([01][0-9]|2[0-3]):[0-5][0-9]\z"


def fix_hour(c: Column) -> Column:
    """Rewrite a hand-typed clock time as ``HH:MM``; null when it is not a time.

    ``;`` and ``::`` are read as ``:``, inner spaces are dropped, and three or four
    characters without a mark are read as ``H MM`` or ``HH MM``.
    """
    typed_in = c.cast("string")
    text = strip_whitespace(typed_in)
    for typed, meant in ((";", ":"), ("::", ":"), (" ", "")):
        text = F.replace(text, F.lit(typed), F.lit(meant))
    marked = F.regexp_replace(text, "^([^:]{1,2})([^:]{2})$", "$1:$2")

    def checked(clock: Column) -> Column:
        return F.when(clock.rlike(CLOCK_PATTERN), F.concat_ws(":", _two_digits(clock, 1), _two_digits(clock, 2)))

    # The repaired text is used three times; a one-element array has it computed once.
    # A time that is in order already needs no repair.
    return F.when(typed_in.rlike(CLEAN_PATTERN), typed_in).otherwise(F.transform(F.array(marked), checked)[0])


def _two_digits(clock: Column, part: int) -> Column:
    number = F.split_part(clock, F.lit(":"), F.lit(part)).try_cast("int")
    return F.lpad(number.cast("string"), 2, "0")
