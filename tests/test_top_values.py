"""Top values from sketches, and panels from grouping sets."""

import re

import pytest
from pyspark.sql import functions as F

from tableprofile.operators import dashboard, heavy, profile


def rows(df):
    return sorted(map(tuple, df.select("column", "rank", "value", "count").collect()))


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    text = n.cast("string")
    return spark.range(30_000).select(
        F.when(n % 3 == 0, F.lit("hot")).otherwise(F.floor(F.sqrt(text.cast("double"))).cast("string")).alias("skewed"),
        F.concat(F.lit("v"), text).alias("flat"),
        F.concat(F.repeat(F.lit("long "), 20), (n % 50).cast("string")).alias("a.b"),
        F.lit(None).cast("string").alias("empty"),
        F.when(n % 7 == 0, "").otherwise((n % 2000).cast("string")).alias("tied"),
        n.alias("number"),
    )


@pytest.mark.parametrize("sizes", [{}, {"candidates": 1, "tracked": 8, "buckets": 7}, {"candidates": 1, "tracked": 8, "buckets": 50_000}])
def test_top_values_equal_the_full_count(table, sizes):
    assert rows(heavy.top_values(table, 4, **sizes)) == rows(profile.categorical_top_k(table, 4))


def test_few_values_and_no_rows(spark, table):
    two = spark.createDataFrame([("a", None), ("a", None), ("b", None)], "x string, y string")
    assert rows(heavy.top_values(two, 5)) == [("x", 1, "a", 2), ("x", 2, "b", 1)]
    assert rows(heavy.top_values(table.limit(0), 5)) == []
    assert rows(heavy.top_values(table.select("number"), 5)) == []


def test_a_skewed_column_is_not_counted_in_full(spark, table):
    plan = heavy.top_values(table.select("skewed"), 1)._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan.split("Window")[-1]  # the counts are the candidates' alone, known already


def test_dashboard_equals_the_single_panels(spark):
    n = F.col("id")
    df = spark.range(5000).select(
        F.when(n % 11 > 0, (n % 30).cast("string")).alias("clase_siniestro"),
        (n % 90).cast("string").alias("barrio"),
        (n % 3).alias("zona"),
        F.when(n % 5 > 0, F.date_format(F.date_add(F.lit("2023-01-15").cast("date"), (n % 700).cast("int")), "yyyy-MM-dd")).alias("fecha"),
    )
    got = dashboard.dashboard(df)
    found = {}
    for r in got.orderBy("panel", "rank").collect():
        found.setdefault(r.panel, []).append((r.value, r["count"]))
    for panel, column, k in (("tipo_siniestro", "clase_siniestro", 10), ("barrio", "barrio", 15), ("zona", "zona", None)):
        want = [(str(r.value), r["count"]) for r in profile.value_counts(df.select(F.col(column).cast("string")), column).collect()]
        assert found[panel] == want[:k]
    assert sum(c for _, c in found["year"]) == sum(c for _, c in found["month"]) == 4000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bRange \(", plan)) <= 2 and "Expand" in plan
    assert dashboard.dashboard(df.select("id") if "id" in df.columns else spark.range(3)).count() == 0
    assert {r.panel for r in dashboard.dashboard(df.limit(0)).collect()} == set()
