"""The dataset report, its metadata and its short summary, as ordered rows and as text.

All of them come from ``profile_record``, one row of facts about a table. Its parts are
one scan for all per-column aggregates, one shuffle of text values and one of other
distinct values per type; the parts that a result does not use are not computed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import is_missing, value_or_null
from .profile import Quantiles, data_bytes, distinct_counts, quartiles, text_value_counts, top_of_counts, with_texts
from .quality import FEW_VALUES, ID_LIKE_SHARE, advice_on, duplicate_count, outlier_count, quality_of
from .schema import DATE, NUMERIC, TEXT, column_array, fields_of_kind, kind_of

# Fixed value: top values per column.
TOP_VALUES = 5

SECTIONS = (
    "quality",
    "structure",
    "columns",
    "numeric",
    "categorical",
    "issues",
    "high_null_columns",
    "recommendations",
)


def profile_record(df: DataFrame, quantiles: Quantiles | None = None, exact: bool = True) -> DataFrame:
    """One row: rows, columns (an array of per-column facts), distinct, top.

    Its size grows with the number of columns only.
    """
    known = quartiles(df) if quantiles is None else quantiles
    position = {f.name: i for i, f in enumerate(df.schema.fields)}

    def number(aggregate: Callable[[Column], Column]):
        def make(f) -> Column:
            if kind_of(f.dataType) != NUMERIC:
                return F.lit(None).cast("double")
            return aggregate(value_or_null(f).cast("double")).cast("double")

        return make

    def quartile(at: int):
        return lambda f: F.lit(known[f.name][at] if f.name in known else None).cast("double")

    columns = column_array(
        df.schema.fields,
        {
            "position": lambda f: F.lit(position[f.name]).cast("long"),
            "dtype": lambda f: F.lit(f.dataType.simpleString()),
            "kind": lambda f: F.lit(kind_of(f.dataType)),
            "nulls": lambda f: F.count_if(is_missing(f)),
            "bytes": lambda f: data_bytes(f).cast("long"),
            "mean": number(F.avg),
            "std": number(F.stddev_samp),
            "min": number(F.min),
            "p25": quartile(0),
            "p50": quartile(1),
            "p75": quartile(2),
            "max": number(F.max),
            "outliers": lambda f: outlier_count(f, known),
        },
    )
    # Maps and lists of a few entries per column.
    texts = text_value_counts(df)
    counted = distinct_counts(df, exact=exact, text_counts=texts)
    distinct = counted.agg(F.map_from_entries(F.collect_list(F.struct("column", "distinct"))))
    top = with_texts(df, top_of_counts(texts, TOP_VALUES)).agg(F.collect_list(F.struct("column", "rank", "value", "count")))
    return df.agg(F.count("*").alias("rows"), columns.alias("columns")).select(
        "*",
        distinct.scalar().alias("distinct"),
        top.scalar().alias("top"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def _each(make: Callable[[Column], list[Column]], kind: str | None = None) -> Column:
    """Rows for every column of the record, or for every column of a kind."""
    columns = F.col("columns") if kind is None else F.filter("columns", lambda c: c["kind"] == kind)
    return F.flatten(F.transform(columns, lambda c: F.array_compact(F.array(*make(c)))))


def _each_top(make: Callable[[Column, Column], list[Column]]) -> Column:
    """Rows for every frequent value, with the facts of its column."""

    def rows(t: Column) -> Column:
        owner = F.element_at(F.filter("columns", lambda c: c["column"] == t["column"]), 1)
        return F.array(*make(t, owner))

    return F.flatten(F.transform("top", rows))


# Metadata -------------------------------------------------------------------


def dataset_metadata(df: DataFrame, quantiles: Quantiles | None = None, exact: bool = True) -> DataFrame:
    """The whole profile in long form: (column, metric, item, value)."""

    def row(column: Column, metric: Column | str, item: Column | None, value: Column | None) -> Column:
        return F.struct(
            column.alias("column"),
            (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
            (F.lit(None) if item is None else item).cast("string").alias("item"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
        )

    def facts(c: Column) -> list[Column]:
        name = c["column"]
        return [
            row(name, "dtype", c["dtype"], None),
            row(name, "null_percent", None, F.try_divide(c["nulls"], F.col("rows")) * 100),
            row(name, "distinct", None, F.element_at("distinct", name)),
        ]

    def numbers(c: Column) -> list[Column]:
        named = {"min": "min", "max": "max", "mean": "mean", "median": "p50"}
        return [row(c["column"], metric, None, c[part]) for metric, part in named.items()]

    table = F.array(
        row(F.lit("*"), "rows", None, F.col("rows")), row(F.lit("*"), "columns", None, F.lit(len(df.columns)))
    )
    samples = _each_top(
        lambda t, c: [row(t["column"], F.concat(F.lit("top_"), t["rank"].cast("string")), t["value"], t["count"])]
    )
    record = profile_record(df, quantiles, exact)
    return record.select(F.inline(F.concat(table, _each(facts), _each(numbers, NUMERIC), samples)))


# Report ---------------------------------------------------------------------


def _row(section: str, order: Column, item: Column, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(SECTIONS.index(section) + 1).cast("long").alias("section_no"),
        order.cast("long").alias("ord"),
        item.cast("string").alias("item"),
        value.cast("double").alias("value"),
    )


def _listed(section: str, values: dict[str, Column]) -> Column:
    return F.array(*(_row(section, F.lit(i), F.lit(n), v) for i, (n, v) in enumerate(values.items(), 1)))


def _column_rows(section: str, c: Column, label: Column, values: dict[str, Column]) -> list[Column]:
    """Rows about one column, in table order; a value that is null gives no row."""
    return [
        F.when(v.isNotNull(), _row(section, c["position"] * 10 + i, F.concat_ws(" ", label, F.lit(n)), v))
        for i, (n, v) in enumerate(values.items())
    ]


def dataset_report(df: DataFrame, quantiles: Quantiles | None = None, exact: bool = True) -> DataFrame:
    """(section, section_no, ord, item, value): everything the report says, in order.

    A few rows per column, whatever the size of the table.
    """
    n_of = {kind: len(fields_of_kind(df, kind)) for kind in (NUMERIC, TEXT, DATE)}
    facts = profile_record(df, quantiles, exact).withColumn("duplicates", duplicate_count(df))
    record = quality_of(facts, len(df.columns), n_of[NUMERIC], "rows", "columns", "distinct", "top")
    rows = F.col("rows")

    quality = _listed(
        "quality",
        {
            "score": F.col("score"),
            "completeness": F.col("completeness"),
            "duplicates": F.col("duplicates"),
            "outlier_columns": F.size("outliers"),
        },
    )
    bytes_ = F.aggregate("columns", F.lit(0).cast("long"), lambda total, c: total + c["bytes"])
    structure = _listed(
        "structure",
        {
            "rows": rows,
            "columns": F.lit(len(df.columns)),
            "cells": rows * len(df.columns),
            "megabytes": bytes_ / float(1024**2),
            **{f"{kind}_columns": F.lit(n) for kind, n in n_of.items()},
        },
    )

    def detail(c: Column) -> list[Column]:
        found = F.element_at("distinct", c["column"])
        label = F.concat(c["column"], F.lit(" ("), c["kind"], F.lit(", "), c["dtype"], F.lit(")"))
        values = {
            "null_percent": F.try_divide(c["nulls"], rows) * 100,
            "distinct": found,
            "cardinality": _share(found, rows),
        }
        return _column_rows("columns", c, label, values)

    def numbers(c: Column) -> list[Column]:
        values = {
            "min": c["min"],
            "max": c["max"],
            "mean": c["mean"],
            "median": c["p50"],
            "range": c["max"] - c["min"],
            "outliers": F.when(c["outliers"] > 0, c["outliers"]),
        }
        return _column_rows("numeric", c, c["column"], values)

    def frequent(t: Column, c: Column) -> list[Column]:
        label = F.concat_ws(" ", t["column"], F.concat(t["rank"].cast("string"), F.lit(".")), t["value"])
        at = c["position"] * 100 + t["rank"] * 2
        return [
            _row("categorical", at, F.concat(label, F.lit(" count")), t["count"]),
            _row("categorical", at + 1, F.concat(label, F.lit(" share")), _share(t["count"], rows - c["nulls"])),
        ]

    issues = F.transform("issues", lambda i, at: _row("issues", at + 1, i["issue"], i["value"]))
    worst_first = F.array_sort(
        F.transform(F.map_entries("high_null_columns"), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("column")))
    )
    nulls = F.transform(worst_first, lambda e, at: _row("high_null_columns", at + 1, e["column"], -e["order"]))

    def texts_with(test: Callable[[Column], Column]) -> Column:
        return F.size(
            F.filter("columns", lambda c: (c["kind"] == TEXT) & test(F.element_at("distinct", c["column"])))
        )

    advice = F.transform(
        advice_on(texts_with(lambda n: n < FEW_VALUES), texts_with(lambda n: n > rows * ID_LIKE_SHARE)),
        lambda a: _row("recommendations", a["ord"], a["recommendation"], a["value"]),
    )
    sections = [quality, structure, _each(detail), _each(numbers, NUMERIC), _each_top(frequent), issues, nulls, advice]
    return record.select(F.inline(F.concat(*sections)))


def _number(value: Column) -> Column:
    """A number as text with four decimals, without an exponent."""
    return F.coalesce(F.round(value, 4).cast("decimal(38,4)").cast("string"), F.lit("-"))


def _numbered_lines(report: DataFrame) -> DataFrame:
    line = F.concat(F.col("section"), F.lit(" | "), F.col("item"), F.lit(": "), _number(F.col("value")))
    return report.select("section_no", "ord", "item", line.alias("line"))


def report_lines(report: DataFrame) -> DataFrame:
    """The report as lines of text, in order: one string column ``value``, for a text sink."""
    return _numbered_lines(report).orderBy("section_no", "ord", "item").select(F.col("line").alias("value"))


def report_text(report: DataFrame) -> DataFrame:
    """The report as one text. Its lines are a few per column of the table."""
    lines = F.array_sort(F.collect_list(F.struct("section_no", "ord", "item", "line")))
    return _numbered_lines(report).agg(
        F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text")
    )


# Summary --------------------------------------------------------------------


def context_summary(df: DataFrame, quantiles: Quantiles | None = None, exact: bool = True) -> DataFrame:
    """One row, one text: shape, columns, numeric description, most frequent values; all of them."""

    def described(c: Column) -> list[Column]:
        values = {"count": F.col("rows") - c["nulls"], **{n: c[n] for n in ("mean", "std", "min", "p25", "p50", "p75", "max")}}
        figures = F.concat_ws(", ", *(F.concat(F.lit(f"{n} "), _number(v)) for n, v in values.items()))
        return [F.concat(F.lit("numeric "), c["column"], F.lit(": "), figures)]

    shape = F.array(F.format_string(f"shape: %d rows, {len(df.columns)} columns", F.col("rows")))
    columns = _each(lambda c: [F.format_string("column %s (%s)", c["column"], c["dtype"])])
    in_order = _each_top(
        lambda t, c: [
            F.struct(
                c["position"].alias("position"),
                t["rank"].alias("rank"),
                F.format_string("top %s %d. %s: %d", t["column"], t["rank"], t["value"], t["count"]).alias("line"),
            )
        ]
    )
    frequent = F.transform(F.array_sort(in_order), lambda r: r["line"])
    lines = F.concat(shape, columns, _each(described, NUMERIC), frequent)
    record = profile_record(df, quantiles, exact)
    return record.select(F.array_join(lines, "\n").alias("text"))
