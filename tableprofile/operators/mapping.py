"""Points of any number on a map: counts of cells at several zoom levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trends import valid_points

FINEST_ZOOM = 12
MOST_ZOOM = 16


def _spread(v: Column) -> Column:
    """The lowest 16 bits of a number with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def z_order(x: Column, y: Column) -> Column:
    """The bits of two numbers in turn, those of ``x`` at the even places."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def map_cells(df: DataFrame, latitude: str, longitude: str, finest: int = FINEST_ZOOM) -> DataFrame:
    """(zoom, cell, points, west, south, degrees_wide, degrees_high): the cells that hold points, at each zoom level.

    At zoom z the earth is 2^z by 2^z cells, numbered by interleaved bits: the number of a
    cell without its last two bits is that of the cell around it one level up. Points are
    counted once, at the finest level; every other level adds up cells, not points, so the
    levels cost the more points there are no more. Each level adds up to the valid points.
    """
    if not 0 <= finest <= MOST_ZOOM:
        raise ValueError(f"zoom levels go up to {MOST_ZOOM}")
    across = 1 << finest

    def place(c: str, low: float, width: float) -> Column:
        at = F.floor((F.col(c) - F.lit(low)) / F.lit(width) * across)
        return F.least(at, F.lit(across - 1)).cast("long")

    points = valid_points(df, latitude, longitude).select(place("lon", -180.0, 360.0).alias("x"), place("lat", -90.0, 180.0).alias("y"))
    cells = points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("points"))
    up = F.lit(finest) - F.col("zoom")

    def above(c: str) -> Column:
        return F.call_function("shiftright", F.col(c), up).alias(c)

    levels = (
        cells.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(finest))))
        .select("zoom", above("x"), above("y"), "points")
        .groupBy("zoom", "x", "y")
        .agg(F.sum("points").alias("points"))
    )
    wide, high = F.lit(360.0) / F.pow(F.lit(2.0), "zoom"), F.lit(180.0) / F.pow(F.lit(2.0), "zoom")
    return levels.select(
        "zoom",
        z_order(F.col("x"), F.col("y")).alias("cell"),
        "points",
        (F.col("x") * wide - 180).alias("west"),
        (F.col("y") * high - 90).alias("south"),
        wide.alias("degrees_wide"),
        high.alias("degrees_high"),
    )
