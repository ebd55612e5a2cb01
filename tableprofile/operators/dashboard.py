"""All panels of a dashboard from one scan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import month_label
from ..functions.names import column as named
from .roles import INCIDENT_ROLES, Roles, find_roles
from .schema import bounded_key
from .trends import moment

# How many values each panel shows; a panel without a number shows all.
PANEL_VALUES = {"tipo_siniestro": 10, "barrio": 15, "direccion": 10}
YEAR, MONTH = "year", "month"


def incident_panels(df: DataFrame, roles: Roles = INCIDENT_ROLES) -> dict[str, Column]:
    """What each panel counts: the column of each role that the table has, and the year and month of its dates."""
    found = find_roles(df, roles)
    panels = {
        role: bounded_key(named(c).cast("string"))
        for role, c in found.items()
        if c is not None and role not in ("fecha", "latitud", "longitud")
    }
    if found.get("fecha") is not None:
        at = moment(df, found["fecha"])
        panels |= {YEAR: F.year(at).cast("string"), MONTH: month_label(at)}
    return panels


def dashboard(df: DataFrame, panels: Mapping[str, Column] | None = None, limits: Mapping[str, int] = PANEL_VALUES) -> DataFrame:
    """(panel, value, count, rank): the frequencies of every panel, most frequent first, ties by value.

    ``GROUPING SETS`` with one set a panel: one scan, and one shuffle of counts that map
    tasks have combined; the rank cuts each task to its panel's limit before the few rows
    left are brought together. Nulls are left out. Each panel equals its own ``value_counts``,
    but for texts of 64 bytes or more, which are shown as their digests.
    """
    panels = incident_panels(df) if panels is None else dict(panels)
    if not panels:
        return df.sparkSession.createDataFrame([], "panel string, value string, count long, rank int")
    names = [f"p{i}" for i in range(len(panels))]
    rows = df.select(*(c.alias(n) for n, c in zip(names, panels.values(), strict=True)))
    sets = [[F.col(n)] for n in names]
    grouped = rows.groupingSets(sets, *names).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("set"))
    # In grouping_id the bit of the one grouped column is 0, the first column's being the highest.
    everything = (1 << len(names)) - 1
    by_set = [(everything ^ (1 << (len(names) - 1 - i)), panel, n) for i, (panel, n) in enumerate(zip(panels, names, strict=True))]
    panel = reduce(lambda c, x: c.when(F.col("set") == x[0], F.lit(x[1])), by_set[1:], F.when(F.col("set") == by_set[0][0], F.lit(by_set[0][1])))
    value = F.coalesce(*(F.when(F.col("set") == s, F.col(n)) for s, _, n in by_set))
    long = grouped.select(panel.alias("panel"), value.alias("value"), "count").where(F.col("value").isNotNull())
    rank = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("count"), "value"))
    limited = [p for p in panels if p in limits]
    most = max([limits[p] for p in limited], default=0)
    cut = long.where(F.col("panel").isin(limited)).withColumn("rank", rank).where(F.col("rank") <= most)
    for p in limited:
        cut = cut.where((F.col("panel") != p) | (F.col("rank") <= limits[p]))
    whole = long.where(~F.col("panel").isin(limited)).withColumn("rank", rank)
    return cut.unionByName(whole)
