"""Growing profiles, map cells and formats against the plain operators."""

import pytest
from pyspark.sql import functions as F

from tableprofile.operators import formats, growing, mapping, profile, trends
from tableprofile.operators.schema import kind_of


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    return spark.range(20_000).select(
        (n % 5).cast("string").alias("part"),
        n.alias("unique"),
        F.when(n % 4 > 0, (n % 700).cast("double") + 1e6).alias("number"),
        F.when(n % 10 == 0, F.lit(float("nan"))).otherwise(F.lit(2.5)).alias("holes"),
        (n % 40).cast("string").alias("text"),
        F.lit(None).cast("double").alias("empty"),
        F.current_date().alias("day"),
    )


def check(merged, df):
    df = df.drop("part")
    got = {r.column: r for r in merged.collect()}
    described = {r.column: r for r in profile.describe_numeric(df).collect()}
    distinct = {r.column: r["distinct"] for r in profile.distinct_counts(df).collect()}
    sizes = {r.column: r["bytes"] for r in profile.column_bytes(df).collect()}
    nulls = {r.column: r.nulls for r in profile.null_percent(df).collect()}
    rows = df.count()
    assert set(got) == set(df.columns)
    for f in df.schema.fields:
        r = got[f.name]
        assert (r.rows, r.nulls, r.bytes) == (rows, nulls[f.name], sizes[f.name])
        assert abs(r.distinct - distinct[f.name]) <= 0.03 * distinct[f.name]
        if kind_of(f.dataType) == "numeric":
            want = described[f.name]
            for name, value in (("min", r.min), ("max", r.max), ("mean", r.mean), ("std", r.std)):
                assert value == (None if want[name] is None else pytest.approx(want[name], rel=1e-9, abs=1e-9)), (f.name, name)
            values = sorted(v[0] for v in df.select(f.name).collect() if v[0] is not None and v[0] == v[0])
            for p, value in ((0.25, r.p25), (0.5, r.p50), (0.75, r.p75)):
                if not values:
                    assert value is None
                    continue
                below, upto = (sum(v < value for v in values), sum(v <= value for v in values))
                assert below / len(values) - 0.01 <= p <= upto / len(values) + 0.01


def test_merged_parts_are_the_profile_of_the_whole(spark, table, tmp_path):
    path = str(tmp_path / "profiles")
    for part in ("0", "1"):
        growing.store_profiles(table.where(F.col("part") == part), path, ["part"])
    growing.store_profiles(table.where("part > '1'"), path, ["part"])
    check(growing.merged_profile(spark.read.parquet(path)), table)
    # A part that changed takes the place of what was stored; others stay.
    changed = table.where("part != '1' OR unique % 2 = 0")
    growing.store_profiles(changed.where("part = '1'"), path, ["part"])
    check(growing.merged_profile(spark.read.parquet(path)), changed)
    growing.forget_partitions(spark, path, F.col("part").isin("2", "4"))
    check(growing.merged_profile(spark.read.parquet(path)), changed.where("part NOT IN ('2', '4')"))


def test_one_scan_a_part_and_one_row_a_task(spark, table):
    plan = growing.partial_profiles(table, ["part"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Expand" not in plan
    assert growing.merged_profile(growing.partial_profiles(table.limit(0), ["part"])).count() == 0


def test_levels_add_up_to_the_valid_points(spark):
    rows = [("3,5", "-76,3"), ("3,5", "-76,3"), ("90", "180"), ("-90", "-180"), ("0", "0"), ("91", "0"), (None, "1"), ("x", "1")]
    df = spark.createDataFrame(rows, "lat string, lon string")
    cells = mapping.map_cells(df, "lat", "lon", finest=16).cache()
    valid = trends.points_coverage(df, "lat", "lon").first().valid_points
    assert valid == 5
    assert {r.zoom: r.n for r in cells.groupBy("zoom").agg(F.sum("points").alias("n")).collect()} == dict.fromkeys(range(17), valid)
    assert [tuple(r)[1:] for r in cells.where("zoom = 0").collect()] == [(0, 5, -180.0, -90.0, 360.0, 180.0)]
    assert {(r.cell, r.points) for r in cells.where("zoom = 1").collect()} == {(0, 1), (2, 2), (3, 2)}
    # The cell around a cell has its number without the last two bits.
    inner = cells.where("zoom = 16").select(F.shiftright("cell", 2).alias("cell"), "points").groupBy("cell").agg(F.sum("points").alias("points"))
    assert {tuple(r) for r in inner.collect()} == {(r.cell, r.points) for r in cells.where("zoom = 15").collect()}
    assert mapping.map_cells(df.limit(0), "lat", "lon").count() == 0
    with pytest.raises(ValueError):
        mapping.map_cells(df, "lat", "lon", finest=17)


def test_the_whole_column_tells_the_format(spark):
    rows = [("01/02/2024", "01/02/2024", "1.234,5", "1,234.5", "7", None), ("03/04/2024", "03/13/2024", "-2", "x", "b", None)]
    rows += [("25/12/2023", "bad", "0,5", "12", "c", None), (None, None, "x", "1,23", "d", None)]
    df = spark.createDataFrame(rows, "`a.b` string, us string, comma string, point string, words string, empty string")
    found = formats.inferred_formats(df)
    assert sorted(map(tuple, found.collect())) == [
        ("a.b", "date", "dd/MM/yyyy", 3, 3, 0),
        ("comma", "decimal", "1.234,5", 3, 4, 1),
        ("empty", "text", None, 0, 0, 0),
        ("point", "decimal", "1,234.5", 2, 4, 2),
        ("us", "date", "MM/dd/yyyy", 2, 3, 1),
        ("words", "text", None, 0, 4, 0),
    ]
    got = formats.read_by_formats(df, found)
    assert [t for _, t in got.dtypes] == ["timestamp", "timestamp", "double", "double", "string", "string"]
    assert [r.comma for r in got.collect()] == [1234.5, -2.0, 0.5, None] and [r.point for r in got.collect()] == [1234.5, None, 12.0, None]
    assert [r.us and r.us.day for r in got.collect()] == [2, 13, None, None]
    assert formats.inferred_formats(df.limit(0)).where("kind != 'text'").count() == 0
    assert formats.inferred_formats(spark.range(3)).count() == 0
