"""Queries on growing tables, maps and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import formats, growing, mapping
from ..session import scratch_path
from . import checks
from .cleaning import decimal_sql
from .incidents import WITH, incidents
from .registry import query, read

_GROWN = [c for c in checks.LINEITEM if c[0] != "l_returnflag"]


@query(
    "growing_profile",
    "WITH " + checks.facts("lineitem", _GROWN) + """
    SELECT col AS "column", n AS "rows", nulls, bytes, round(mn, 6) AS "min", round(mx, 6) AS "max",
      round(mean, 4) AS mean, round(std, 4) AS std FROM facts""",
)
def growing_profile(spark, folder):
    """Two parts of the table arrive one after the other; the facts that are exact."""
    lines, path = read(spark, folder, "lineitem"), scratch_path(spark, "profiles")
    for part in (F.col("l_returnflag") == "A", F.col("l_returnflag") != "A"):
        growing.store_profiles(lines.where(part), path, ["l_returnflag"])
    merged = growing.merged_profile(spark.read.parquet(path))
    rounded = [F.round(c, 6).alias(c) for c in ("min", "max")] + [F.round(c, 4).alias(c) for c in ("mean", "std")]
    return merged.select("column", "rows", "nulls", "bytes", *rounded)


@query(
    "map_cells",
    WITH + f""", points AS (SELECT {decimal_sql("lat")} AS lat, {decimal_sql("long")} AS lon FROM incidents),
    placed AS (SELECT z, least((1 << z) - 1, floor((lon + 180) / 360 * (1 << z)))::BIGINT AS x,
        least((1 << z) - 1, floor((lat + 90) / 180 * (1 << z)))::BIGINT AS y
      FROM points, range(13) r(z) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)
    SELECT z::INT AS zoom, list_sum(list_transform(range(16), lambda i: (((x >> i) & 1) << (2 * i)) + (((y >> i) & 1) << (2 * i + 1))))::BIGINT AS cell,
      count(*) AS points, x * (360 / 2.0 ** z) - 180 AS west, y * (180 / 2.0 ** z) - 90 AS south,
      360 / 2.0 ** z AS degrees_wide, 180 / 2.0 ** z AS degrees_high
    FROM placed GROUP BY z, x, y""",
)
def map_cells(spark, folder):
    return mapping.map_cells(incidents(spark, folder), "lat", "long")


# Dates of three orders, two of which only some of the rows tell apart, and decimal numbers.
_WRITTEN = """SELECT ipat, fecha,
    substr(fecha, 9, 2) || '/' || substr(fecha, 6, 2) || '/' || substr(fecha, 1, 4) AS european,
    substr(fecha, 6, 2) || '/' || substr(fecha, 9, 2) || '/' || substr(fecha, 1, 4) AS american,
    lat, zona FROM """

_FORMAT_SQL = {
    "yyyy-MM-dd": "try_strptime({c}, '%Y-%m-%d')",
    "yyyy-MM-dd HH:mm:ss": "try_strptime({c}, '%Y-%m-%d %H:%M:%S')",
    "dd/MM/yyyy": "try_strptime({c}, '%d/%m/%Y')",
    "MM/dd/yyyy": "try_strptime({c}, '%m/%d/%Y')",
    "1.234,5": r"CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+|[0-9]{{1,3}}([.][0-9]{{3}})+)([,][0-9]+)?') THEN 1 END",
}


def _written(spark, folder):
    return spark.sql(_WRITTEN + "{rows}", rows=incidents(spark, folder))


@query(
    "inferred_formats",
    WITH + f", written AS ({_WRITTEN} incidents), scored AS (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS col, {i} AS ord, '{f}' AS form, count({sql.format(c=c)}) AS fits, count({c}) AS vals FROM written"""
        for c in ("fecha", "european", "american", "lat", "zona")
        for i, (f, sql) in enumerate(_FORMAT_SQL.items())
    ) + """) SELECT col AS "column", CASE WHEN NOT good THEN 'text' WHEN form LIKE '%,%' THEN 'decimal' ELSE 'date' END AS kind,
      CASE WHEN good THEN form END AS format, CASE WHEN good THEN fits ELSE 0 END AS fits, vals AS "values",
      CASE WHEN good THEN vals - fits ELSE 0 END AS misfits
    FROM (SELECT *, fits > 0 AND fits * 2 >= vals AS good FROM scored QUALIFY row_number() OVER (PARTITION BY col ORDER BY fits DESC, ord) = 1)""",
)
def inferred_formats(spark, folder):
    return formats.inferred_formats(_written(spark, folder))


@query(
    "read_by_formats",
    WITH + f", written AS ({_WRITTEN} incidents)" + r""" SELECT ipat, try_strptime(fecha, '%Y-%m-%d') AS fecha,
      try_strptime(european, '%d/%m/%Y') AS european, try_strptime(american, '%m/%d/%Y') AS american,
      CASE WHEN regexp_full_match(lat, '[+-]?([0-9]+|[0-9]{1,3}([.][0-9]{3})+)([,][0-9]+)?')
        THEN TRY_CAST(replace(replace(lat, '.', ''), ',', '.') AS DOUBLE) END AS lat, zona FROM written""",
)
def read_by_formats(spark, folder):
    rows = _written(spark, folder)
    found = formats.read_by_formats(rows, formats.inferred_formats(rows))
    return found.withColumns({c: F.to_timestamp_ntz(F.col(c).cast("string")) for c in ("fecha", "european", "american")})
