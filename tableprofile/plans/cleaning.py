"""Cleaning queries on the incident table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dataset_slug, fix_hour, locale_decimal, normalise_url, parse_decimal
from ..operators import cleaning, trends
from .incidents import COLUMNS, WITH, incidents
from .registry import query, read

NUMBER_SQL = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def decimal_sql(c: str) -> str:
    plain = f"replace(trim({c}), ',', '.')"
    return f"CASE WHEN regexp_matches({plain}, {NUMBER_SQL}) THEN TRY_CAST({plain} AS DOUBLE) END"


def hour_sql(c: str) -> str:
    """The checking SQL of the hour rule, step by step."""
    return f"""(SELECT CASE WHEN hh BETWEEN 0 AND 23 AND mm BETWEEN 0 AND 59
        THEN lpad(CAST(hh AS VARCHAR), 2, '0') || ':' || lpad(CAST(mm AS VARCHAR), 2, '0') END
      FROM (SELECT TRY_CAST(split_part(t, ':', 1) AS INT) AS hh, TRY_CAST(split_part(t, ':', 2) AS INT) AS mm
        FROM (SELECT CASE WHEN contains(s, ':') THEN CASE WHEN len(string_split(s, ':')) = 2 THEN s END
            WHEN length(s) = 4 THEN substr(s, 1, 2) || ':' || substr(s, 3)
            WHEN length(s) = 3 THEN substr(s, 1, 1) || ':' || substr(s, 2) END AS t
          FROM (SELECT replace(replace(replace(trim({c}), ';', ':'), '::', ':'), ' ', '') AS s))))"""


_NAMES = [c for c, _, _ in COLUMNS]
_ANY_NULL = " OR ".join(f"{c} IS NULL" for c in _NAMES)
_CLEAN = ", ".join(
    f"{decimal_sql(c)} AS {c}" if c in ("lat", "long", "edad") else f"{hour_sql(c)} AS {c}" if c == "hora" else c
    for c in _NAMES
)
# Three columns that can all be empty at once.
_SPARSE = ["hora", "lat", "hipotesis"]


@query("drop_all_null_rows", WITH + "SELECT hora, lat, hipotesis FROM incidents WHERE NOT (hora IS NULL AND lat IS NULL AND hipotesis IS NULL)")
def drop_all_null_rows(spark, folder):
    return cleaning.drop_all_null_rows(incidents(spark, folder).select(*_SPARSE))


@query("drop_any_null_rows", WITH + f"SELECT * FROM incidents WHERE NOT ({_ANY_NULL})")
def drop_any_null_rows(spark, folder):
    return cleaning.drop_any_null_rows(incidents(spark, folder))


@query(
    "normalise_na",
    WITH + """, spoiled AS (SELECT ipat, coalesce(hora, 'NA') AS hora, coalesce(hipotesis, '<NA>') AS hipotesis,
      CASE WHEN lat = 'no aplica' THEN 'n/a' ELSE coalesce(lat, '') END AS lat FROM incidents)
    SELECT ipat, nullif(hora, 'NA') AS hora, nullif(hipotesis, '<NA>') AS hipotesis,
      CASE WHEN lat NOT IN ('n/a', '') THEN lat END AS lat FROM spoiled""",
)
def normalise_na(spark, folder):
    spoiled = incidents(spark, folder).select(
        "ipat",
        F.coalesce("hora", F.lit("NA")).alias("hora"),
        F.coalesce("hipotesis", F.lit("<NA>")).alias("hipotesis"),
        F.when(F.col("lat") == "no aplica", "n/a").otherwise(F.coalesce("lat", F.lit(""))).alias("lat"),
    )
    return cleaning.normalise_na(spoiled)


@query("parse_decimal", WITH + f'SELECT ipat, {decimal_sql("lat")} AS lat, {decimal_sql("long")} AS "long" FROM incidents')
def parse_decimal_query(spark, folder):
    return incidents(spark, folder).select("ipat", *(parse_decimal(F.col(c)).alias(c) for c in ("lat", "long")))


@query("fix_hour", WITH + f"SELECT ipat, {hour_sql('hora')} AS hora FROM incidents")
def fix_hour_query(spark, folder):
    return incidents(spark, folder).select("ipat", fix_hour(F.col("hora")).alias("hora"))


@query(
    "locale_decimal",
    WITH + f"""SELECT ipat, replace(CAST({decimal_sql("lat")} AS VARCHAR), '.', ',') AS lat,
    replace(CAST({decimal_sql("edad")} AS VARCHAR), '.', ',') AS edad FROM incidents""",
)
def locale_decimal_query(spark, folder):
    return incidents(spark, folder).select(
        "ipat", *(locale_decimal(parse_decimal(F.col(c))).alias(c) for c in ("lat", "edad"))
    )


@query(
    "retention_report",
    WITH + f"""SELECT 'incidents' AS dataset, count(*) AS initial_rows, count(*) FILTER (WHERE NOT ({_ANY_NULL})) AS final_rows,
    round(count(*) FILTER (WHERE NOT ({_ANY_NULL})) / count(*) * 100, 6) AS percent FROM incidents""",
)
def retention_report(spark, folder):
    kept = cleaning.retention_report(incidents(spark, folder), "incidents", drop_any=True)
    return kept.withColumn("percent", F.round("percent", 6))


@query("clean_dataset", WITH + f"SELECT {_CLEAN} FROM incidents")
def clean_dataset(spark, folder):
    return cleaning.clean_dataset(incidents(spark, folder))


@query("parse_dates", WITH + "SELECT ipat, fecha, CAST(try_strptime(fecha, '%Y-%m-%d') AS DATE) AS fecha_dt FROM incidents")
def parse_dates(spark, folder):
    dated = trends.parse_dates(incidents(spark, folder).select("ipat", "fecha"), "fecha", "fecha_dt")
    return dated.withColumn("fecha_dt", F.to_date("fecha_dt"))


_POINTS = WITH + f""", points AS (SELECT {decimal_sql("lat")} AS lat, {decimal_sql("long")} AS lon FROM incidents)
"""


@query("valid_points", _POINTS + "SELECT lat, lon FROM points WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def valid_points(spark, folder):
    return trends.valid_points(incidents(spark, folder), "lat", "long")


@query(
    "points_coverage",
    _POINTS + """SELECT count(*) FILTER (WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) AS valid_points,
    count(*) AS "rows" FROM points""",
)
def points_coverage(spark, folder):
    return trends.points_coverage(incidents(spark, folder), "lat", "long")


@query(
    "count_by_year",
    'SELECT CAST(year(l_shipdate) AS BIGINT) AS "year", count(*) AS "count" FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1',
)
def count_by_year(spark, folder):
    return trends.count_by_year(read(spark, folder, "lineitem"), "l_shipdate")


@query(
    "count_by_month",
    """SELECT strftime(o_orderdate, '%Y-%m') AS "month", count(*) AS "count" FROM orders WHERE o_orderdate IS NOT NULL
    GROUP BY 1""",
)
def count_by_month(spark, folder):
    return trends.count_by_month(read(spark, folder, "orders"), "o_orderdate")


@query(
    "count_by_month_text",
    WITH + """SELECT strftime(try_strptime(fecha, '%Y-%m-%d'), '%Y-%m') AS "month", count(*) AS "count" FROM incidents
    GROUP BY 1""",
)
def count_by_month_text(spark, folder):
    return trends.count_by_month(incidents(spark, folder), "fecha")


@query(
    "normalise_url",
    """SELECT page_id, CASE WHEN base LIKE '%.json' THEN base ELSE rtrim(base, '/') || '.json' END AS url
    FROM (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+://[^?#]*)', 1) AS base FROM pages)""",
)
def normalise_url_query(spark, folder):
    return read(spark, folder, "pages").select("page_id", normalise_url(F.col("url")).alias("url"))


@query(
    "dataset_slug",
    "SELECT p_partkey, replace(replace(lower(p_brand || ' ' || p_name || '-' || p_type), ' ', '_'), '-', '_') || '.csv' AS slug FROM part",
)
def dataset_slug_query(spark, folder):
    name = F.concat("p_brand", F.lit(" "), "p_name", F.lit("-"), "p_type")
    return read(spark, folder, "part").select("p_partkey", dataset_slug(name).alias("slug"))
