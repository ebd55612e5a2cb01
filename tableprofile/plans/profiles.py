"""Profile queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dashboard as panels
from ..operators import heavy, profile, report
from . import checks
from .incidents import COLUMNS, CTE, WITH, incidents
from .registry import query, read


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_FACTS = "WITH " + CTE + ",\n" + checks.facts("incidents", COLUMNS) + "\n"
_LINEITEM = "WITH " + checks.facts("lineitem", checks.LINEITEM) + "\n"
_EVENTS = "WITH " + checks.facts("events", checks.EVENTS) + "\n"
_TOPS = "WITH " + CTE + ",\n" + checks.tops("incidents", COLUMNS) + "\n"


@query("table_shape", 'SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS "columns", count(*) * 11 AS cells FROM lineitem')
def table_shape(spark, folder):
    return profile.table_shape(read(spark, folder, "lineitem"))


@query(
    "column_types",
    _FACTS + """SELECT kind, count(*) AS n_columns, string_agg(col, ',' ORDER BY position) AS "columns",
    CAST(sum(n - nulls) AS BIGINT) AS "values" FROM facts GROUP BY kind""",
)
def column_types(spark, folder):
    return profile.column_types(incidents(spark, folder))


@query("head_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def head_rows(spark, folder):
    return profile.head_rows(read(spark, folder, "orders"), 10, "o_orderkey")


@query(
    "completeness",
    _FACTS + """SELECT any_value(n) AS "rows", any_value(n) * count(*) AS cells, CAST(sum(nulls) AS BIGINT) AS null_cells,
    round((any_value(n) * count(*) - sum(nulls)) / (any_value(n) * count(*)) * 100, 6) AS completeness FROM facts""",
)
def completeness(spark, folder):
    return _rounded(profile.completeness(incidents(spark, folder)), "completeness")


@query("null_percent", _FACTS + 'SELECT col AS "column", nulls, round(nulls / n * 100, 6) AS null_percent FROM facts')
def null_percent(spark, folder):
    return _rounded(profile.null_percent(incidents(spark, folder)), "null_percent")


@query("distinct_counts", _LINEITEM + 'SELECT col AS "column", dist AS "distinct" FROM facts')
def distinct_counts(spark, folder):
    return profile.distinct_counts(read(spark, folder, "lineitem"))


@query(
    "distinct_counts_text",
    """SELECT 'doc_id' AS "column", count(DISTINCT doc_id) AS "distinct" FROM documents
    UNION ALL SELECT 'text', count(DISTINCT text) FROM documents
    UNION ALL SELECT 'lang', count(DISTINCT lang) FROM documents
    UNION ALL SELECT 'source', count(DISTINCT source) FROM documents
    UNION ALL SELECT 'n_chars', count(DISTINCT n_chars) FROM documents""",
)
def distinct_counts_text(spark, folder):
    return profile.distinct_counts(read(spark, folder, "documents"))


@query(
    "numeric_stats",
    _LINEITEM + """SELECT col AS "column", round(mn, 6) AS "min", round(mx, 6) AS "max", round(mean, 4) AS mean,
    round(q2, 6) AS median, round(mx - mn, 6) AS "range" FROM facts WHERE kind = 'numeric'""",
)
def numeric_stats(spark, folder):
    stats = profile.numeric_stats(read(spark, folder, "lineitem"))
    return _rounded(_rounded(stats, "min", "max", "median", "range"), "mean", digits=4)


@query(
    "describe_numeric",
    _LINEITEM + """SELECT col AS "column", n - nulls AS "count", round(mean, 4) AS mean, round(std, 4) AS std,
    round(mn, 6) AS "min", round(q1, 6) AS p25, round(q2, 6) AS p50, round(q3, 6) AS p75, round(mx, 6) AS "max"
    FROM facts WHERE kind = 'numeric'""",
)
def describe_numeric(spark, folder):
    described = profile.describe_numeric(read(spark, folder, "lineitem"))
    return _rounded(_rounded(described, "min", "p25", "p50", "p75", "max"), "mean", "std", digits=4)


@query("categorical_top_k", _TOPS + 'SELECT col AS "column", val AS "value", cnt AS "count", CAST(rnk AS INT) AS rank FROM tops')
def categorical_top_k(spark, folder):
    return profile.categorical_top_k(incidents(spark, folder))


@query(
    "categorical_top_k_long",
    "WITH " + checks.tops("documents", (("text", "string", "text"), ("lang", "string", "text"))) + """
    SELECT col AS "column", val AS "value", cnt AS "count", CAST(rnk AS INT) AS rank FROM tops""",
)
def categorical_top_k_long(spark, folder):
    """Whole documents as values."""
    return profile.categorical_top_k(read(spark, folder, "documents").select("text", "lang"))


@query("top_values", _TOPS + 'SELECT col AS "column", val AS "value", cnt AS "count", CAST(rnk AS INT) AS rank FROM tops')
def top_values(spark, folder):
    """Few values with most rows: the sketch's candidates are proved."""
    return heavy.top_values(incidents(spark, folder))


@query(
    "top_values_flat",
    "WITH " + checks.tops("documents", (("text", "string", "text"), ("source", "string", "text"))) + """
    SELECT col AS "column", val AS "value", cnt AS "count", CAST(rnk AS INT) AS rank FROM tops""",
)
def top_values_flat(spark, folder):
    """Most texts occur once, so the values in doubtful buckets are counted."""
    return heavy.top_values(read(spark, folder, "documents").select("text", "source"))


_PANELS = {
    "tipo_siniestro": "clase_siniestro",
    "tiempo": "jornada",
    "zona": "zona",
    "genero": "genero",
    "barrio": "barrios_corregimiento_via",
    "direccion": "direccion",
    "year": "substr(fecha, 1, 4)",
    "month": "substr(fecha, 1, 7)",
}


@query(
    "dashboard",
    WITH + ", counted AS (" + " UNION ALL ".join(
        f"""SELECT '{panel}' AS panel, {c} AS "value", count(*) AS "count" FROM incidents WHERE {c} IS NOT NULL GROUP BY {c}"""
        for panel, c in _PANELS.items()
    ) + """) SELECT *, CAST(row_number() OVER (PARTITION BY panel ORDER BY "count" DESC, "value") AS INT) AS rank FROM counted
    QUALIFY rank <= CASE panel """ + " ".join(f"WHEN '{p}' THEN {n}" for p, n in panels.PANEL_VALUES.items()) + " ELSE 2147483647 END",
)
def dashboard(spark, folder):
    return panels.dashboard(incidents(spark, folder))


@query(
    "categorical_share",
    _TOPS + """SELECT col AS "column", CAST(rnk AS INT) AS rank, val AS "value", cnt AS "count", round(cnt / filled * 100, 6) AS share,
    CAST(floor(cnt / filled * 100 / 2) AS BIGINT) AS bar_length FROM tops""",
)
def categorical_share(spark, folder):
    return _rounded(profile.categorical_share(incidents(spark, folder)), "share")


@query(
    "column_detail",
    _EVENTS + """SELECT col AS "column", position, dtype, kind, round(nulls / n * 100, 6) AS null_percent,
    dist AS "distinct", round(dist / n * 100, 6) AS cardinality FROM facts""",
)
def column_detail(spark, folder):
    return _rounded(profile.column_detail(read(spark, folder, "events")), "null_percent", "cardinality")


@query(
    "value_counts",
    'SELECT o_orderpriority AS "value", count(*) AS "count" FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1',
)
def value_counts(spark, folder):
    return profile.value_counts(read(spark, folder, "orders"), "o_orderpriority")


@query(
    "top_k",
    WITH + """SELECT direccion AS "value", count(*) AS "count" FROM incidents WHERE direccion IS NOT NULL
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def top_k(spark, folder):
    return profile.top_k(incidents(spark, folder), "direccion", 10)


@query(
    "mode_with_count",
    """SELECT o_orderpriority AS "value", array_to_string(list_transform(
      regexp_extract_all(o_orderpriority, '([a-zA-Z]+|[^a-zA-Z]+)'),
      lambda w: upper(w[1]) || lower(w[2:])), '') AS label, count(*) AS "count"
    FROM orders GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 1""",
)
def mode_with_count(spark, folder):
    return profile.mode_with_count(read(spark, folder, "orders"), "o_orderpriority")


@query(
    "column_panel",
    WITH + """SELECT 'summary' AS section, 'distinct' AS item, CAST(count(DISTINCT hipotesis) AS DOUBLE) AS "value",
      'string' AS dtype FROM incidents
    UNION ALL SELECT 'summary', 'nulls', count(*) - count(hipotesis), 'string' FROM incidents
    UNION ALL (SELECT 'top', hipotesis, count(*), 'string' FROM incidents WHERE hipotesis IS NOT NULL
      GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""",
)
def column_panel(spark, folder):
    return profile.column_panel(incidents(spark, folder), "hipotesis")


@query(
    "column_panel_numeric",
    "WITH " + checks.facts("events", checks.EVENTS) + ", one AS (FROM facts WHERE col = 'value')\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{section}' AS section, '{item}' AS item, round(CAST({value} AS DOUBLE), 4) AS \"value\", 'double' AS dtype FROM one"
        for section, item, value in (
            ("summary", "distinct", "dist"), ("summary", "nulls", "nulls"), ("describe", "count", "n - nulls"),
            ("describe", "mean", "mean"), ("describe", "std", "std"), ("describe", "min", "mn"),
            ("describe", "p25", "q1"), ("describe", "p50", "q2"), ("describe", "p75", "q3"), ("describe", "max", "mx"),
        )
    ),
)
def column_panel_numeric(spark, folder):
    return _rounded(profile.column_panel(read(spark, folder, "events"), "value"), "value", digits=4)


@query(
    "column_bytes",
    """SELECT "column", bytes, round(bytes / 1048576.0, 6) AS megabytes FROM (
      SELECT 'doc_id' AS "column", 8 * count(*) AS bytes FROM documents
      UNION ALL SELECT 'text', CAST(sum(strlen(text)) AS BIGINT) FROM documents
      UNION ALL SELECT 'lang', CAST(sum(strlen(lang)) AS BIGINT) FROM documents
      UNION ALL SELECT 'source', CAST(sum(strlen(source)) AS BIGINT) FROM documents
      UNION ALL SELECT 'n_chars', 8 * count(*) FROM documents)""",
)
def column_bytes(spark, folder):
    return _rounded(profile.column_bytes(read(spark, folder, "documents")), "megabytes")


@query(
    "dataset_metadata",
    "WITH " + checks.facts("events", checks.EVENTS) + ",\n" + checks.tops("events", checks.EVENTS) + """
    SELECT '*' AS "column", 'rows' AS metric, CAST(NULL AS VARCHAR) AS item, CAST(count(*) AS DOUBLE) AS "value" FROM events
    UNION ALL SELECT '*', 'columns', NULL, 6
    UNION ALL SELECT col, 'dtype', dtype, NULL FROM facts
    UNION ALL SELECT col, 'null_percent', NULL, round(nulls / n * 100, 4) FROM facts
    UNION ALL SELECT col, 'distinct', NULL, dist FROM facts
    UNION ALL SELECT col, 'min', NULL, round(mn, 4) FROM facts WHERE kind = 'numeric'
    UNION ALL SELECT col, 'max', NULL, round(mx, 4) FROM facts WHERE kind = 'numeric'
    UNION ALL SELECT col, 'mean', NULL, round(mean, 4) FROM facts WHERE kind = 'numeric'
    UNION ALL SELECT col, 'median', NULL, round(q2, 4) FROM facts WHERE kind = 'numeric'
    UNION ALL SELECT col, 'top_' || rnk, val, cnt FROM tops""",
)
def dataset_metadata(spark, folder):
    return _rounded(report.dataset_metadata(read(spark, folder, "events")), "value", digits=4)


@query(
    "context_summary",
    "WITH " + CTE + ",\n" + checks.summary_text_cte("incidents", COLUMNS) + "\nSELECT text FROM summary_text",
)
def context_summary(spark, folder):
    return report.context_summary(incidents(spark, folder))
