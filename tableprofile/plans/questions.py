"""The standard questions on the incident table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import questions
from .cleaning import decimal_sql, hour_sql
from .incidents import WITH, incidents
from .registry import query


def _top_sql(column: str, k: int, where: str = "TRUE") -> str:
    return WITH + f"""SELECT {column} AS "value", count(*) AS "count" FROM incidents
    WHERE {column} IS NOT NULL AND {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"""


@query("q_top_type", _top_sql("clase_siniestro", 1))
def q_top_type(spark, folder):
    return questions.most_frequent(incidents(spark, folder), "clase_siniestro")


@query("q_top_shift", _top_sql("jornada", 1))
def q_top_shift(spark, folder):
    return questions.most_frequent(incidents(spark, folder), "jornada")


@query("q_top_causes", _top_sql("hipotesis", 10))
def q_top_causes(spark, folder):
    return questions.most_frequent(incidents(spark, folder), "hipotesis", 10)


@query("q_top_gender", _top_sql("genero", 1))
def q_top_gender(spark, folder):
    return questions.most_frequent(incidents(spark, folder), "genero")


@query("q_by_zone", WITH + 'SELECT zona AS "value", count(*) AS "count" FROM incidents WHERE zona IS NOT NULL GROUP BY 1')
def q_by_zone(spark, folder):
    return questions.by_zone(incidents(spark, folder))


@query(
    "q_type_in_year",
    WITH + """SELECT count(*) AS "count" FROM incidents
    WHERE clase_siniestro = 'CLICK' AND year(try_strptime(fecha, '%Y-%m-%d')) = 2024""",
)
def q_type_in_year(spark, folder):
    return questions.type_in_year(incidents(spark, folder), "clase_siniestro", "CLICK", "fecha", 2024)


@query(
    "q_risk_hour",
    WITH + f""", hours AS (SELECT substr({hour_sql("hora")}, 1, 2) AS h FROM incidents)
    SELECT h AS "value", count(*) AS "count" FROM hours WHERE h IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def q_risk_hour(spark, folder):
    return questions.risk_hour(incidents(spark, folder))


@query(
    "q_mean_age",
    WITH + f"""SELECT round(avg({decimal_sql("edad")}), 6) AS mean_age, count({decimal_sql("edad")}) AS ages FROM incidents""",
)
def q_mean_age(spark, folder):
    return questions.mean_age(incidents(spark, folder)).withColumn("mean_age", F.round("mean_age", 6))


@query(
    "q_age_groups",
    WITH + f""", ages AS (SELECT CAST(floor({decimal_sql("edad")} / 10) * 10 AS BIGINT) AS g FROM incidents)
    SELECT g AS "value", count(*) AS "count" FROM ages WHERE g IS NOT NULL GROUP BY 1""",
)
def q_age_groups(spark, folder):
    return questions.age_groups(incidents(spark, folder))


@query(
    "q_type_share",
    WITH + """SELECT count(*) FILTER (WHERE clase_siniestro = 'CLICK') AS "count", count(clase_siniestro) AS total,
    round(count(*) FILTER (WHERE clase_siniestro = 'CLICK') / count(clase_siniestro) * 100, 6) AS share FROM incidents""",
)
def q_type_share(spark, folder):
    share = questions.type_share(incidents(spark, folder), "clase_siniestro", "CLICK")
    return share.withColumn("share", F.round("share", 6))


@query("q_top_cause_in_zone", _top_sql("hipotesis", 1, "zona = 'RURAL'"))
def q_top_cause_in_zone(spark, folder):
    return questions.top_cause_in_zone(incidents(spark, folder), "RURAL")
