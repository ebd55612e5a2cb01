"""Building blocks of the checking SQL: facts per column of one table."""

from __future__ import annotations

from collections.abc import Sequence

Columns = Sequence[tuple[str, str, str]]  # name, type, kind

ORDERS: Columns = (
    ("o_orderkey", "bigint", "numeric"),
    ("o_custkey", "bigint", "numeric"),
    ("o_orderstatus", "string", "text"),
    ("o_totalprice", "double", "numeric"),
    ("o_orderdate", "timestamp_ntz", "date"),
    ("o_orderpriority", "string", "text"),
)
CUSTOMER: Columns = (
    ("c_custkey", "bigint", "numeric"),
    ("c_name", "string", "text"),
    ("c_nationkey", "int", "numeric"),
    ("c_acctbal", "double", "numeric"),
    ("c_mktsegment", "string", "text"),
)
LINEITEM: Columns = (
    ("l_orderkey", "bigint", "numeric"),
    ("l_partkey", "bigint", "numeric"),
    ("l_suppkey", "bigint", "numeric"),
    ("l_linenumber", "int", "numeric"),
    ("l_quantity", "double", "numeric"),
    ("l_extendedprice", "double", "numeric"),
    ("l_discount", "double", "numeric"),
    ("l_tax", "double", "numeric"),
    ("l_returnflag", "string", "text"),
    ("l_linestatus", "string", "text"),
    ("l_shipdate", "timestamp_ntz", "date"),
)
EVENTS: Columns = (
    ("event_id", "bigint", "numeric"),
    ("ts", "timestamp_ntz", "date"),
    ("user_id", "bigint", "numeric"),
    ("event_type", "string", "text"),
    ("value", "double", "numeric"),
    ("props", "string", "text"),
)

WIDTHS = {"bigint": 8, "int": 4, "double": 8, "timestamp_ntz": 8}


def _fact(table: str, position: int, name: str, dtype: str, kind: str) -> str:
    size = f"{WIDTHS[dtype]} * count(*)" if dtype in WIDTHS else f"coalesce(sum(strlen({name})), 0)"
    common = f"""CAST({position} AS BIGINT) AS position, '{name}' AS col, '{dtype}' AS dtype, '{kind}' AS kind,
        count(*) AS n, count(*) - count({name}) AS nulls, count(DISTINCT {name}) AS dist,
        CAST({size} AS BIGINT) AS bytes"""
    if kind != "numeric":
        numbers = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("mn", "mx", "mean", "std", "q1", "q2", "q3"))
        return f"SELECT {common}, {numbers}, CAST(0 AS BIGINT) AS outliers FROM {table}"
    q = {i: f"quantile_cont(CAST({name} AS DOUBLE), 0.{25 * i})" for i in (1, 2, 3)}
    low, high = (f"{q[1]} - 1.5 * ({q[3]} - {q[1]})", f"{q[3]} + 1.5 * ({q[3]} - {q[1]})")
    return f"""SELECT {common}, CAST(min({name}) AS DOUBLE) AS mn, CAST(max({name}) AS DOUBLE) AS mx,
        avg(CAST({name} AS DOUBLE)) AS mean, stddev_samp(CAST({name} AS DOUBLE)) AS std,
        {q[1]} AS q1, {q[2]} AS q2, {q[3]} AS q3,
        (SELECT count(*) FROM {table}, (SELECT {low} AS low, {high} AS high FROM {table}) AS fence
         WHERE {name} < low OR {name} > high) AS outliers
        FROM {table}"""


def facts(table: str, columns: Columns) -> str:
    """A CTE with one row per column and everything the profile says about it."""
    rows = (_fact(table, i, *c) for i, c in enumerate(columns))
    return "facts AS (" + "\nUNION ALL\n".join(rows) + ")"


def tops(table: str, columns: Columns) -> str:
    """A CTE with the five most frequent values of every text column."""
    rows = (
        f"""SELECT {i} AS position, '{name}' AS col, {name} AS val, count(*) AS cnt,
        row_number() OVER (ORDER BY count(*) DESC, CASE WHEN strlen({name}) < 64 THEN {name} ELSE sha256({name}) END) AS rnk,
        sum(count(*)) OVER () AS filled
        FROM {table} WHERE {name} IS NOT NULL GROUP BY {name} QUALIFY rnk <= 5"""
        for i, (name, _, kind) in enumerate(columns)
        if kind == "text"
    )
    return "tops AS (" + "\nUNION ALL\n".join(rows) + ")"


def duplicates(table: str, columns: Columns) -> str:
    names = ", ".join(c[0] for c in columns)
    return f"""dup AS (SELECT coalesce(sum(k - 1), 0) AS duplicates
        FROM (SELECT count(*) AS k FROM {table} GROUP BY {names}))"""


# One row: the score and the figures it comes from.
QUALITY = """quality AS (
    SELECT n, width, duplicates, completeness, outlier_columns, null_columns,
      round(completeness * 0.5 + (100 - CAST(duplicates AS DOUBLE) / n * 100) * 0.3
        + (100 - least(outlier_columns / greatest(numeric_columns, 1) * 100, 100)) * 0.2, 1) AS score
    FROM (SELECT any_value(n) AS n, count(*) AS width,
        (any_value(n) * count(*) - sum(nulls)) / (any_value(n) * count(*)) * 100 AS completeness,
        count(*) FILTER (WHERE outliers > 0) AS outlier_columns,
        count(*) FILTER (WHERE kind = 'numeric') AS numeric_columns,
        count(*) FILTER (WHERE nulls / n * 100 > 20) AS null_columns
      FROM facts), dup)"""

ISSUES = """issues AS (
    SELECT 1 AS ord, 'low_completeness' AS issue, CAST(round(completeness, 1) AS DOUBLE) AS value
      FROM quality WHERE completeness < 90
    UNION ALL SELECT 2, 'duplicate_rows', duplicates FROM quality WHERE duplicates > 0
    UNION ALL SELECT 3, 'outlier_columns', outlier_columns FROM quality WHERE outlier_columns > 0
    UNION ALL SELECT 4, 'high_null_columns', null_columns FROM quality WHERE null_columns > 0)"""

ADVICE = """cardinality AS (
    SELECT count(*) FILTER (WHERE dist < 10) AS low, count(*) FILTER (WHERE dist > n * 0.8) AS high
    FROM facts WHERE kind = 'text'),
  some_advice AS (
    SELECT 1 AS ord, 'drop_duplicates' AS recommendation, CAST(duplicates AS DOUBLE) AS value
      FROM quality WHERE duplicates > 0
    UNION ALL SELECT 2, 'review_high_null_columns', null_columns FROM quality WHERE null_columns > 0
    UNION ALL SELECT 3, 'review_outliers', outlier_columns FROM quality WHERE outlier_columns > 0
    UNION ALL SELECT 4, 'deep_clean', score FROM quality WHERE score < 80
    UNION ALL SELECT 5, 'encode_low_cardinality', low FROM cardinality WHERE low > 0
    UNION ALL SELECT 6, 'review_high_cardinality', high FROM cardinality WHERE high > 0),
  advice AS (
    SELECT ord, recommendation, value FROM some_advice
    UNION ALL SELECT 0, 'excellent', score FROM quality WHERE NOT EXISTS (SELECT * FROM some_advice))"""


def quality_ctes(table: str, columns: Columns) -> str:
    return ",\n".join((facts(table, columns), duplicates(table, columns), QUALITY, ISSUES, ADVICE))


def _unpivot(section: str, number: int, source: str, order: str, item: str, names: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{section}', {number}, {order.format(i=i)}, {item.format(name=name)}, CAST({value} AS DOUBLE) FROM {source}"
        for i, (name, value) in enumerate(names.items())
    )


def report_ctes(table: str, columns: Columns) -> str:
    """CTEs up to ``report``: the rows of the dataset report."""
    numeric = {"min": "mn", "max": "mx", "mean": "mean", "median": "q2", "range": "mx - mn"}
    parts = [
        _unpivot(
            "quality", 1, "quality", "{i} + 1", "'{name}'",
            {"score": "score", "completeness": "round(completeness, 1)", "duplicates": "duplicates",
             "outlier_columns": "outlier_columns"},
        ),
        _unpivot(
            "structure", 2, "structure", "{i} + 1", "'{name}'",
            {"rows": "n", "columns": "width", "cells": "n * width", "megabytes": "megabytes",
             "numeric_columns": "numeric_columns", "text_columns": "text_columns", "date_columns": "date_columns"},
        ),
        _unpivot(
            "columns", 3, "facts", "position * 10 + {i}",
            "col || ' (' || kind || ', ' || dtype || ') {name}'",
            {"null_percent": "nulls / n * 100", "distinct": "dist", "cardinality": "dist / n * 100"},
        ),
        _unpivot(
            "numeric", 4, "(FROM facts WHERE kind = 'numeric' AND mn IS NOT NULL)", "position * 10 + {i}",
            "col || ' {name}'", numeric,
        ),
        "SELECT 'numeric', 4, position * 10 + 5, col || ' outliers', outliers FROM facts WHERE outliers > 0",
        _unpivot(
            "categorical", 5, "tops", "position * 100 + rnk * 2 + {i}",
            "col || ' ' || rnk || '. ' || val || ' {name}'",
            {"count": "cnt", "share": "cnt / filled * 100"},
        ),
        "SELECT 'issues', 6, row_number() OVER (ORDER BY ord), issue, value FROM issues",
        """SELECT 'high_null_columns', 7, row_number() OVER (ORDER BY round(nulls / n * 100, 1) DESC, col), col,
           round(nulls / n * 100, 1) FROM facts WHERE nulls / n * 100 > 20""",
        "SELECT 'recommendations', 8, ord, recommendation, value FROM advice",
    ]
    structure = """structure AS (SELECT any_value(n) AS n, count(*) AS width, sum(bytes / 1048576.0) AS megabytes,
        count(*) FILTER (WHERE kind = 'numeric') AS numeric_columns,
        count(*) FILTER (WHERE kind = 'text') AS text_columns,
        count(*) FILTER (WHERE kind = 'date') AS date_columns FROM facts)"""
    report = "report(section, section_no, ord, item, value) AS (" + "\nUNION ALL\n".join(parts) + ")"
    return ",\n".join((quality_ctes(table, columns), tops(table, columns), structure, report))


def number(value: str) -> str:
    return f"coalesce(CAST(CAST(round({value}, 4) AS DECIMAL(38, 4)) AS VARCHAR), '-')"


def report_text_cte(table: str, columns: Columns) -> str:
    """CTEs up to ``report_text``: the report as one text."""
    line = f"section || ' | ' || item || ': ' || {number('value')}"
    return report_ctes(table, columns) + (
        f",\nreport_text AS (SELECT string_agg({line}, chr(10) ORDER BY section_no, ord, item) AS text FROM report)"
    )


def summary_text_cte(table: str, columns: Columns) -> str:
    """CTEs up to ``summary_text``: the short summary as one text."""
    described = {"count": "n - nulls", "mean": "mean", "std": "std", "min": "mn", "p25": "q1", "p50": "q2",
                 "p75": "q3", "max": "mx"}
    figures = " || ', ' || ".join(f"'{name} ' || {number(value)}" for name, value in described.items())
    return f"""{facts(table, columns)},
{tops(table, columns)},
summary_lines AS (
    SELECT 1 AS block, 0 AS ord, 'shape: ' || any_value(n) || ' rows, ' || count(*) || ' columns' AS line FROM facts
    UNION ALL SELECT 2, position, 'column ' || col || ' (' || dtype || ')' FROM facts
    UNION ALL SELECT 3, position, 'numeric ' || col || ': ' || {figures} FROM facts WHERE kind = 'numeric'
    UNION ALL SELECT 4, position * 10 + rnk, 'top ' || col || ' ' || rnk || '. ' || val || ': ' || cnt FROM tops),
summary_text AS (SELECT string_agg(line, chr(10) ORDER BY block, ord) AS text FROM summary_lines)"""
