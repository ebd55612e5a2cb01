"""Text expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that ``str.strip`` and ``str.split`` take as whitespace.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


@cache
def _accent_table() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter or digit, and what they decompose to.

    Canonical decompositions onto ASCII all lie below U+3000.
    """
    accented, plain = [], []
    for code in range(0x80, 0x3000):
        head = unicodedata.normalize("NFD", chr(code))[0]
        if head.isascii() and head.isalnum():
            accented.append(chr(code))
            plain.append(head)
    return "".join(accented), "".join(plain)


def strip_whitespace(c: Column) -> Column:
    """Trim every kind of whitespace, not only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def normalise_text(c: Column) -> Column:
    """Fold accents and case and keep only ``a-z0-9``."""
    # Marks that stand alone are outside a-z0-9, so the last step drops them too.
    accented, plain = _accent_table()
    return F.regexp_replace(F.lower(F.translate(c, accented, plain)), "[^a-z0-9]", "")


def normalise_name(name: str) -> str:
    """``normalise_text`` for a column name, at plan time."""
    folded = unicodedata.normalize("NFD", name).lower()
    return "".join(ch for ch in folded if ch.isascii() and ch.isalnum())


def word_count(c: Column) -> Column:
    """Number of whitespace-separated words."""
    # Splitting at one plain character needs no regular expression.
    spaced = F.translate(c, WHITESPACE, " " * len(WHITESPACE))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def text_preview(c: Column, chars: int = 2000) -> Column:
    """The first ``chars`` characters."""
    return F.substring(c, 1, chars)


def truncate_text(c: Column, chars: int) -> Column:
    """Struct of the first ``chars`` characters and whether any were cut."""
    return F.struct(F.substring(c, 1, chars).alias("text"), (F.length(c) > chars).alias("truncated"))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters, also after an apostrophe or a hyphen."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def dataset_slug(c: Column) -> Column:
    """File name of a dataset: lower case, spaces and hyphens as underscores."""
    return F.concat(F.translate(F.lower(c), " -", "__"), F.lit(".csv"))


def report_file_name(c: Column) -> Column:
    """File name of a report: lower case, spaces as underscores, hyphens kept."""
    return F.concat(F.lit("reporte_"), F.translate(F.lower(c), " ", "_"), F.lit(".txt"))
