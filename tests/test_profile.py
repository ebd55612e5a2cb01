"""Profiles, exact quantiles and quality against plain computations."""

import math

import pytest
from pyspark.sql import functions as F

from tableprofile.operators import profile, quality, report
from tableprofile.operators.quantiles import approximate_quantiles, exact_quantiles
from tableprofile.operators.schema import NUMERIC, fields_of_kind

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]


def _quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.fixture(scope="module")
def mixed(spark):
    """Numbers of many shapes: unique, heavily repeated, constant, sparse, signed, with NaN."""
    n = F.col("id")
    return spark.range(20_000).select(
        (F.xxhash64(n) % 1_000_003).alias("spread"),
        F.when(n % 3 == 0, 7.0).otherwise((n % 1000).cast("double")).alias("hot"),
        F.lit(5).alias("constant"),
        F.when(n % 1000 == 0, n.cast("float")).alias("sparse"),
        F.when(n % 5 == 0, F.lit(float("nan"))).otherwise(F.exp((n % 700).cast("double")) * -1).alias("skewed"),
        F.lit(None).cast("double").alias("empty"),
        (n / 3).cast("decimal(12,4)").alias("exactly"),
    )


@pytest.mark.parametrize("accuracy", [50, 1000, 10_000])
def test_quantiles_are_exact_whatever_the_sketch_tells(mixed, accuracy):
    fields = fields_of_kind(mixed, NUMERIC)
    found = exact_quantiles(mixed, fields, PROBABILITIES, accuracy)
    for f in fields:
        values = [float(r[0]) for r in mixed.select(f.name).collect() if r[0] is not None and r[0] == r[0]]
        if not values:
            assert found[f.name] == [None] * len(PROBABILITIES)
            continue
        for p, got in zip(PROBABILITIES, found[f.name]):
            assert got == pytest.approx(_quantile(values, p), rel=1e-12, abs=1e-12), (f.name, p)


def test_quantiles_of_a_hot_value_need_no_large_group(spark):
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 1.5).otherwise(F.col("id")).cast("double").alias("v"))
    assert exact_quantiles(hot, hot.schema.fields, [0.25, 0.5], accuracy=100)["v"] == [1.5, 1.5]


@pytest.mark.parametrize("n", [3000, 40_000, 400_000])
def test_quantile_scans_bring_together_bins_not_rows(spark, monkeypatch, n):
    from tableprofile.operators import quantiles

    whole, scans = quantiles._histograms, []

    def counted(numbers, intervals, bins):
        found = whole(numbers, intervals, bins)
        scans.append(max(map(len, found)))
        return found

    monkeypatch.setattr(quantiles, "_histograms", counted)
    x = F.col("id").cast("double")
    columns = {
        "even": x,
        "steep": F.exp(x * 600 / n) - F.exp(F.lit(300.0)),
        "ends": F.when(F.col("id") % 10 == 0, F.lit(float("inf"))).when(F.col("id") % 10 == 1, F.lit(float("-inf"))).otherwise(x * 1e300),
    }
    df = spark.range(n).select(*(c.alias(k) for k, c in columns.items()))
    shares = [0.0, 0.2345, 0.5, 0.75]
    found = exact_quantiles(df, df.schema.fields, shares, accuracy=500)
    for k in columns:
        values = sorted(r[0] for r in df.select(k).collect())
        ends = [(values[math.floor((n - 1) * p)], values[math.ceil((n - 1) * p)]) for p in shares]
        want = [low if low == high else _quantile(values, p) for p, (low, high) in zip(shares, ends, strict=True)]
        assert found[k] == pytest.approx(want, rel=1e-12)
    assert len(scans) <= 12 and max(scans) <= quantiles.FEW_ROWS  # a steep column takes most scans


def test_approximate_quantiles_are_near(mixed):
    fields = [f for f in mixed.schema.fields if f.name in ("spread", "empty")]
    found = approximate_quantiles(mixed, fields, [0.5])
    values = sorted(r[0] for r in mixed.select("spread").collect())
    assert abs(sum(v <= found["spread"][0] for v in values) / len(values) - 0.5) < 0.01
    assert found["empty"] == [None]


def test_distinct_counts_of_every_type(spark):
    long_text = "x" * 500
    df = spark.sql(
        f"""SELECT * FROM VALUES
        (1, 0.0D,  '{long_text}a', array('a, b'),   map('k', 1, 'j', 2), named_struct('f', 1),    X'00', DATE'2020-01-01', true),
        (1, -0.0D, '{long_text}b', array('a', 'b'), map('j', 2, 'k', 1), named_struct('f', NULL), X'01', DATE'2020-01-01', NULL),
        (2, double('nan'), '{long_text}a', NULL,    NULL,                NULL,                    NULL,  NULL,             false)
        AS t(i, d, t, a, m, s, b, dt, bo)"""
    )
    got = {r["column"]: r["distinct"] for r in profile.distinct_counts(df).collect()}
    assert got == {"i": 2, "d": 1, "t": 2, "a": 2, "m": 1, "s": 2, "b": 2, "dt": 1, "bo": 2}
    near = {r["column"]: r["distinct"] for r in profile.distinct_counts(df, exact=False).collect()}
    assert near == got


def test_text_and_its_own_digest_are_different_values(spark):
    import hashlib

    text = "y" * 100
    df = spark.createDataFrame([(text,), (hashlib.sha256(text.encode()).hexdigest(),)], "t string")
    assert profile.distinct_counts(df).first()["distinct"] == 2
    assert quality.duplicate_rows(df).first()["duplicates"] == 0


def test_counts_and_nulls_add_up_to_rows(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority"))
    )
    counted = profile.value_counts(orders, "o_orderpriority").agg(F.sum("count")).first()[0]
    nulls = profile.null_percent(orders).where(F.col("column") == "o_orderpriority").first()["nulls"]
    assert counted + nulls == orders.count()


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        (1, 1.0, "a", "u1", None),
        (2, 2.0, "a", "u2", None),
        (3, 3.0, "b", "u3", "x"),
        (4, 2.0, None, "u4", "x"),
        (5, 100.0, "c", "u5", None),
        (1, 1.0, "a", "u1", None),
        (6, float("nan"), "c", "u6", "z"),
    ]
    return spark.createDataFrame(rows, "k int, v double, c string, id string, s string")


def test_quality_of_a_small_table(small):
    row = quality.quality_record(small).first()
    cells, missing = 35, 1 + 1 + 4
    completeness = (cells - missing) / cells * 100
    assert row["duplicates"] == 1
    assert row["outliers"] == {"v": 1}
    assert row["high_null_columns"] == {"s": 57.1}
    assert row["completeness"] == round(completeness, 1)
    assert row["score"] == round(0.5 * completeness + 0.3 * (100 - 100 / 7) + 0.2 * (100 - 50), 1)
    assert row["band"] == "yellow"
    assert [i["issue"] for i in row["issues"]] == [
        "low_completeness", "duplicate_rows", "outlier_columns", "high_null_columns",
    ]
    advice = [(r["recommendation"], r["value"]) for r in quality.recommendations(small).collect()]
    assert advice == [
        ("drop_duplicates", 1.0),
        ("review_high_null_columns", 1.0),
        ("review_outliers", 1.0),
        ("deep_clean", row["score"]),
        ("encode_low_cardinality", 3.0),
        ("review_high_cardinality", 1.0),
    ]


def test_shared_quartiles_and_approximate_mode_give_the_same_shape(small):
    shared = profile.quartiles(small)
    assert quality.quality_record(small, shared).first() == quality.quality_record(small).first()
    near = profile.quartiles(small, exact=False)
    assert set(near) == set(shared)
    assert report.dataset_report(small, near, exact=False).count() > 20


def test_empty_table_has_no_score(small):
    row = quality.quality_record(small.limit(0)).first()
    assert (row["score"], row["band"], row["completeness"], row["duplicates"]) == (None, None, 0.0, 0)
    assert profile.completeness(small.limit(0)).first()["completeness"] == 0.0
    assert profile.value_counts(small.limit(0), "c").count() == 0
    assert profile.mode_with_count(small.select(F.lit(None).cast("string").alias("c")), "c").count() == 0
    assert {r["distinct"] for r in profile.distinct_counts(small.limit(0)).collect()} == {0}
    assert report.dataset_report(small.limit(0)).count() > 0
    assert report.context_summary(small.limit(0)).first()["text"].startswith("shape: 0 rows, 5 columns")


def test_tables_without_a_kind_of_column(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "t string")
    numbers = spark.createDataFrame([(1,), (2,)], "n int")
    assert profile.numeric_stats(texts).count() == 0
    assert profile.describe_numeric(texts).columns[0] == "column"
    assert profile.categorical_top_k(numbers).count() == 0
    assert profile.categorical_share(numbers).count() == 0
    assert quality.iqr_outliers(texts).count() == 0
    assert quality.low_cardinality(numbers).count() == 0
    assert report.dataset_report(numbers).count() > 0
    assert report.dataset_report(texts).count() > 0


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "`a.b` int, `c``d e` string")
    assert {r["column"] for r in profile.distinct_counts(df).collect()} == {"a.b", "c`d e"}
    assert profile.null_percent(df).count() == 2
    assert quality.quality_record(df).first()["score"] == 100.0
    assert {r["column"] for r in profile.categorical_top_k(df).collect()} == {"c`d e"}
    assert report.dataset_report(df).count() > 0


def test_duplicates_are_rows_minus_distinct_rows(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", "l_returnflag", "l_tax")
    row = quality.duplicate_rows(lines).first()
    assert row["rows"] == lines.count()
    assert row["duplicates"] == row["rows"] - lines.distinct().count()


def test_duplicates_of_zeros_nan_and_long_texts(spark):
    nan = float("nan")
    rows = [(0.0, "a"), (-0.0, "a"), (nan, None), (nan, None), (None, None), (1.0, "x" * 99), (1.0, "x" * 99), (2.0, "b")]
    df = spark.createDataFrame(rows, "d double, t string").withColumn("m", F.create_map(F.lit("k"), F.col("t")))
    assert spark.range(1).select(quality.duplicate_count(df)).first()[0] == 4
    assert tuple(quality.duplicate_rows(df).first()) == (8, 4, 4)
    assert tuple(quality.duplicate_rows(df.where("d = 2")).first()) == (1, 1, 0)
    assert tuple(quality.duplicate_rows(df.limit(0)).first()) == (0, 0, 0)


def test_values_of_neighbouring_columns_are_not_mixed_up(spark):
    rows = [("a", "bc"), ("ab", "c"), (None, "abc"), ("abc", None), ("", "abc"), ("-", "1:a"), (None, "-")]
    assert tuple(quality.duplicate_rows(spark.createDataFrame(rows, "a string, b string")).first()) == (7, 7, 0)


def test_column_panel_of_a_number(spark, small):
    panel = {(r["section"], r["item"]): r["value"] for r in profile.column_panel(small, "k").collect()}
    assert panel["summary", "distinct"] == 6 and panel["describe", "count"] == 7
    assert panel["describe", "p50"] == 3.0


def test_report_text_is_the_report_in_order(small):
    rows = report.dataset_report(small)
    lines = [r["value"] for r in report.report_lines(rows).collect()]
    assert report.report_text(rows).first()["text"] == "\n".join(lines)
    sections = [line.split(" | ")[0] for line in lines]
    assert list(dict.fromkeys(sections)) == list(report.SECTIONS)


def test_summary_has_a_line_for_every_fact(small):
    text = report.context_summary(small).first()["text"]
    assert all(f"column {name} (" in text for name in small.columns)
