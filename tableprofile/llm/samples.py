"""Bounded samples that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null without an id."""
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(folds))


def sample(rows: DataFrame, key: str, n: int, total: int) -> DataFrame:
    """At most ``n`` of the ``total`` rows of ``rows``, the first by a hash of ``key``.

    Rows far from the first ``n`` are left out before any are sorted.
    """
    order = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 30))
    bound = min(1 << 30, (2 * n + 1000) * (1 << 30) // max(1, total))
    return rows.where(order < bound).orderBy(order, key).limit(n)
