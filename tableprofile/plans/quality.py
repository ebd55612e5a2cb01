"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, report
from . import checks
from .incidents import COLUMNS, CTE, WITH, incidents
from .registry import query, read

_QUALITY = "WITH " + CTE + ",\n" + checks.quality_ctes("incidents", COLUMNS) + "\n"
_REPORT = "WITH " + CTE + ",\n" + checks.report_ctes("incidents", COLUMNS) + "\n"


@query(
    "duplicate_rows",
    WITH + """SELECT CAST(sum(k) AS BIGINT) AS "rows", count(*) AS distinct_rows, CAST(sum(k - 1) AS BIGINT) AS duplicates
    FROM (SELECT count(*) AS k FROM incidents GROUP BY zona, genero, clase_siniestro, hipotesis, edad)""",
)
def duplicate_rows(spark, folder):
    return quality.duplicate_rows(
        incidents(spark, folder).select("zona", "genero", "clase_siniestro", "hipotesis", "edad")
    )


@query(
    "duplicate_rows_text",
    """SELECT CAST(sum(k) AS BIGINT) AS "rows", count(*) AS distinct_rows, CAST(sum(k - 1) AS BIGINT) AS duplicates
    FROM (SELECT count(*) AS k FROM documents GROUP BY text, lang, n_chars)""",
)
def duplicate_rows_text(spark, folder):
    return quality.duplicate_rows(read(spark, folder, "documents").select("text", "lang", "n_chars"))


@query(
    "duplicate_rows_whole",
    """WITH planted AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 7 = 0)
    SELECT (SELECT count(*) FROM planted) AS "rows", count(*) AS distinct_rows,
    (SELECT count(*) FROM planted) - count(*) AS duplicates FROM (SELECT DISTINCT * FROM planted)""",
)
def duplicate_rows_whole(spark, folder):
    """All columns, with planted copies."""
    lines = read(spark, folder, "lineitem")
    return quality.duplicate_rows(lines.unionByName(lines.where("l_orderkey % 7 = 0")))


@query(
    "iqr_outliers",
    "WITH " + checks.facts("events", checks.EVENTS) + """
    SELECT col AS "column", round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
    outliers FROM facts WHERE outliers > 0""",
)
def iqr_outliers(spark, folder):
    found = quality.iqr_outliers(read(spark, folder, "events"))
    return found.withColumns({c: F.round(c, 6) for c in ("lower_fence", "upper_fence")})


@query(
    "high_null_columns",
    _QUALITY + """SELECT col AS "column", round(nulls / n * 100, 1) AS null_percent FROM facts WHERE nulls / n * 100 > 20""",
)
def high_null_columns(spark, folder):
    return quality.high_null_columns(incidents(spark, folder))


@query("quality_issues", _QUALITY + 'SELECT issue, value AS "value" FROM issues')
def quality_issues(spark, folder):
    return quality.quality_issues(incidents(spark, folder))


@query(
    "quality_score",
    _QUALITY + """SELECT score, CASE WHEN score >= 80 THEN 'green' WHEN score >= 60 THEN 'yellow' ELSE 'red' END AS band,
    round(completeness, 1) AS completeness, CAST(duplicates AS BIGINT) AS duplicates, outlier_columns FROM quality""",
)
def quality_score(spark, folder):
    return quality.quality_score(incidents(spark, folder))


@query(
    "data_quality",
    _QUALITY + """SELECT 'score' AS metric, CAST(NULL AS VARCHAR) AS item, CAST(score AS DOUBLE) AS "value" FROM quality
    UNION ALL SELECT 'completeness', NULL, round(completeness, 1) FROM quality
    UNION ALL SELECT 'duplicates', NULL, duplicates FROM quality
    UNION ALL SELECT 'total_rows', NULL, n FROM quality
    UNION ALL SELECT 'total_columns', NULL, width FROM quality
    UNION ALL SELECT 'outliers', col, outliers FROM facts WHERE outliers > 0
    UNION ALL SELECT 'high_null_columns', col, round(nulls / n * 100, 1) FROM facts WHERE nulls / n * 100 > 20
    UNION ALL SELECT 'issue', issue, value FROM issues""",
)
def data_quality(spark, folder):
    return quality.data_quality(incidents(spark, folder))


@query("recommendations", _QUALITY + 'SELECT CAST(ord AS BIGINT) AS ord, recommendation, value AS "value" FROM advice')
def recommendations(spark, folder):
    return quality.recommendations(incidents(spark, folder))


@query("low_cardinality", _QUALITY + """SELECT col AS "column", dist AS "distinct" FROM facts WHERE kind = 'text' AND dist < 10""")
def low_cardinality(spark, folder):
    return quality.low_cardinality(incidents(spark, folder))


@query(
    "high_cardinality",
    "WITH " + checks.facts("customer", checks.CUSTOMER)
    + """ SELECT col AS "column", dist AS "distinct" FROM facts WHERE kind = 'text' AND dist > n * 0.8""",
)
def high_cardinality(spark, folder):
    return quality.high_cardinality(read(spark, folder, "customer"))


@query(
    "dataset_report",
    _REPORT + """SELECT section, CAST(section_no AS BIGINT) AS section_no, CAST(ord AS BIGINT) AS ord, item,
    round(value, 4) AS "value" FROM report""",
)
def dataset_report(spark, folder):
    return report.dataset_report(incidents(spark, folder)).withColumn("value", F.round("value", 4))
