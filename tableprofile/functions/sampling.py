"""Random choices that depend on a row's key and a seed, not on its partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_order(key: Column, seed: int) -> Column:
    """A pseudo-random sort key; the same on any cluster and any partitioning."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def uniform_from_key(key: Column, seed: int, salt: str) -> Column:
    """A double in [0, 1) drawn from the key, the seed and a salt per use."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
