"""Exact quantiles of many columns, without moving or ordering the data.

Spark's ``percentile`` keeps every distinct value of a column in the memory of one
task. Here the rank of a quantile is closed in by histograms: each scan counts the rows
in the bins of the interval that a rank lies in, with the least and greatest value of
each bin, and goes on with the bin that holds the rank, until that is one value or so
few rows that the values are their own bins. Counts are combined in the map tasks, so a
scan shuffles bins, however many rows there are, and the number of scans grows with the
logarithm of the rows. The source has to give the same rows each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import value_or_null

# A scan cuts an interval into so many bins at most, and all intervals together into so many.
ACCURACY = 4096
BINS_PER_SCAN = 1 << 17
# An interval with so many rows is settled by counting its values.
FEW_ROWS = 2048
# A scan whose fullest bin keeps more than this share of the rows was ill cut.
ILL_CUT = 0.125
# Above every exponent of a double, below none: log2 of the least positive one is -1074.
_SHIFT, _MOST = 1100.0, 1025.0


@dataclass(frozen=True)
class _Interval:
    """Values of one column from ``low`` to ``high``, both present, in ``rows`` rows."""

    column: int
    low: float
    high: float
    rows: int
    by_exponent: bool


@dataclass(frozen=True)
class _Wanted:
    """Two neighbouring positions, or one twice, among the sorted rows of an interval."""

    column: int
    probability: int
    first: int
    last: int
    interval: _Interval


def _aggregate(df: DataFrame, columns: Iterable[Column]) -> list:
    return list(df.agg(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def _exponent(v: float) -> float:
    """Grows with ``v``, evenly in its exponent."""
    if not v:
        return 0.0
    return math.copysign((min(math.log2(abs(v)), _MOST) if math.isfinite(v) else _MOST) + _SHIFT, v)


def _bin(interval: _Interval, bins: int) -> Column:
    """The bin of a value of the interval; it never falls while values grow."""
    v = F.col(f"v{interval.column}")
    if interval.rows <= FEW_ROWS:
        return v
    low, width = interval.low, interval.high - interval.low
    # Infinite ends, and widths that are, have no even bins.
    if interval.by_exponent or not math.isfinite(width):
        size = F.least(F.log2(F.abs(v)), F.lit(_MOST)) + F.lit(_SHIFT)
        v = F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * size)
        low, width = _exponent(interval.low), _exponent(interval.high) - _exponent(interval.low)
        if not width:
            return F.lit(0.0)
    at = F.floor((v - F.lit(low)) / F.lit(width) * bins)
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("double")


def _histograms(numbers: DataFrame, intervals: Sequence[_Interval], bins: int) -> list[list[tuple]]:
    """Per interval (rows, least, greatest value) of each bin that has rows, in order."""
    inside = F.array(
        *(
            F.when(
                F.col(f"v{x.column}").between(F.lit(x.low), F.lit(x.high)),
                F.struct(F.lit(k).alias("interval"), _bin(x, bins).alias("bin"), F.col(f"v{x.column}").alias("value")),
            )
            for k, x in enumerate(intervals)
        )
    )
    counted = (
        numbers.select(F.explode(F.array_compact(inside)).alias("x"))
        .groupBy("x.interval", "x.bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("x.value").alias("low"), F.max("x.value").alias("high"))
    )
    found: list[list[tuple]] = [[] for _ in intervals]
    for r in counted.collect():  # BINS_PER_SCAN and FEW_ROWS an interval at most
        found[r["interval"]].append((r["low"], r["n"], r["high"]))
    return [[(n, low, high) for low, n, high in sorted(rows)] for rows in found]


def _narrowed(wanted: _Wanted, histogram: list[tuple]) -> _Wanted | tuple[float, float]:
    """The two values if the histogram tells them, else the positions in their bin."""
    ends, before = [], 0
    for n, low, high in histogram:
        for position in (wanted.first, wanted.last):
            if before <= position < before + n:
                ends.append((n, low, high, before))
        before += n
    (n, low, high, before), last = ends
    if (n, low, high, before) != last:
        return high, last[1]  # the last row of one bin and the first of the next
    if low == high:
        return low, high
    old = wanted.interval
    ill_cut = n > ILL_CUT * old.rows and not old.by_exponent
    return replace(
        wanted, first=wanted.first - before, last=wanted.last - before, interval=_Interval(old.column, low, high, n, ill_cut)
    )


def exact_quantiles(
    df: DataFrame, fields: Sequence[T.StructField], probabilities: Sequence[float], accuracy: int = ACCURACY
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, as bounded scalars on the driver.

    The counterpart of ``DataFrame.approxQuantile`` with exact results. Nulls and NaN
    are left out; a column without values gives ``None``. A scan is accurate to one in
    ``accuracy`` of an interval: it cuts it into so many bins of even width, or of even
    width of the exponent where the scan before left most rows in one bin.
    """
    if not fields:
        return {}
    # -0 becomes 0, so that both are one value.
    numbers = df.select(*((value_or_null(f).cast("double") + F.lit(0.0)).alias(f"v{i}") for i, f in enumerate(fields)))
    facts = _aggregate(numbers, (F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")) for v in numbers.columns))
    wanted, values = [], {}
    for i, fact in enumerate(facts):
        for j, p in enumerate(probabilities):
            if fact["n"]:
                at = (fact["n"] - 1) * p
                whole = _Interval(i, fact["low"], fact["high"], fact["n"], False)
                wanted.append(_Wanted(i, j, math.floor(at), math.ceil(at), whole))
                if fact["low"] == fact["high"]:
                    values[i, j] = fact["low"], fact["high"]
    wanted = [w for w in wanted if (w.column, w.probability) not in values]
    while wanted:
        intervals = list(dict.fromkeys(w.interval for w in wanted))
        bins = max(2, min(accuracy, BINS_PER_SCAN // len(intervals)))
        histograms = dict(zip(intervals, _histograms(numbers, intervals, bins), strict=True))
        narrowed = [(w, _narrowed(w, histograms[w.interval])) for w in wanted]
        values |= {(w.column, w.probability): pair for w, pair in narrowed if isinstance(pair, tuple)}
        wanted = [w for _, w in narrowed if isinstance(w, _Wanted)]
    result: dict[str, list[float | None]] = {f.name: [None] * len(probabilities) for f in fields}
    for (i, j), (left, right) in values.items():
        at = (facts[i]["n"] - 1) * probabilities[j]
        weight = at - math.floor(at)
        result[fields[i].name][j] = left if left == right else left * (1 - weight) + right * weight
    return result


def approximate_quantiles(
    df: DataFrame, fields: Sequence[T.StructField], probabilities: Sequence[float], accuracy: int = 1000
) -> dict[str, list[float | None]]:
    """The same from one scan, each within ``1/accuracy`` of the wanted rank."""
    if not fields:
        return {}
    numbers = df.select(*(value_or_null(f).cast("double").alias(f"c{i}") for i, f in enumerate(fields)))
    found = numbers.approxQuantile(numbers.columns, [float(p) for p in probabilities], 1 / accuracy)
    return {f.name: list(q) or [None] * len(probabilities) for f, q in zip(fields, found)}
