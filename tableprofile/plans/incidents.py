"""An incident table with dirty values, derived from all rows of ``events``.

The same text runs on Spark and as the checking SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import read

INCIDENTS = """
SELECT
  event_id AS ipat,
  CAST(year(ts) AS INT) AS a_o,
  upper(event_type) AS clase_siniestro,
  substr(CAST(ts AS STRING), 1, 10) AS fecha,
  CASE event_id % 9
    WHEN 0 THEN substr(CAST(ts AS STRING), 12, 5)
    WHEN 1 THEN substr(CAST(ts AS STRING), 12, 2) || ';' || substr(CAST(ts AS STRING), 15, 2)
    WHEN 2 THEN substr(CAST(ts AS STRING), 12, 2) || '::' || substr(CAST(ts AS STRING), 15, 2)
    WHEN 3 THEN ' ' || substr(CAST(ts AS STRING), 12, 2) || ' : ' || substr(CAST(ts AS STRING), 15, 2)
    WHEN 4 THEN substr(CAST(ts AS STRING), 12, 2) || substr(CAST(ts AS STRING), 15, 2)
    WHEN 5 THEN '3' || substr(CAST(ts AS STRING), 15, 2)
    WHEN 6 THEN '25:' || substr(CAST(ts AS STRING), 15, 2)
    WHEN 7 THEN 'sin dato'
  END AS hora,
  CASE event_id % 3 WHEN 0 THEN 'MAÑANA' WHEN 1 THEN 'TARDE' ELSE 'NOCHE' END AS jornada,
  'BARRIO ' || CAST(user_id % 40 AS STRING) AS barrios_corregimiento_via,
  'CALLE ' || CAST(user_id % 97 AS STRING) AS direccion,
  CASE WHEN event_id % 4 = 0 THEN 'RURAL' ELSE 'URBANA' END AS zona,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 11 = 1 THEN 'no aplica'
       WHEN event_id % 11 = 2 THEN '95,5'
       ELSE '3,' || CAST(51000 + event_id % 900 AS STRING) END AS lat,
  CASE WHEN event_id % 11 = 0 THEN NULL
       ELSE '-76,' || CAST(29000 + event_id % 700 AS STRING) END AS long,
  CASE WHEN event_id % 4 = 1 THEN NULL
       ELSE 'HIPOTESIS ' || CAST(user_id % 7 AS STRING) END AS hipotesis,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(15 + event_id % 60 AS STRING) END AS edad,
  CASE WHEN event_id % 20 = 0 THEN 'NO REPORTA'
       WHEN event_id % 20 < 8 THEN 'FEMENINO' ELSE 'MASCULINO' END AS genero,
  CAST(value AS DOUBLE) AS costo
FROM {events}
"""

# The table as a common table expression of the checking SQL.
CTE = "incidents AS (" + INCIDENTS.format(events="events") + ")"
WITH = "WITH " + CTE + "\n"

COLUMNS = (
    ("ipat", "bigint", "numeric"),
    ("a_o", "int", "numeric"),
    ("clase_siniestro", "string", "text"),
    ("fecha", "string", "text"),
    ("hora", "string", "text"),
    ("jornada", "string", "text"),
    ("barrios_corregimiento_via", "string", "text"),
    ("direccion", "string", "text"),
    ("zona", "string", "text"),
    ("lat", "string", "text"),
    ("long", "string", "text"),
    ("hipotesis", "string", "text"),
    ("edad", "string", "text"),
    ("genero", "string", "text"),
    ("costo", "double", "numeric"),
)


def incidents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(INCIDENTS, events=read(spark, folder, "events"))
