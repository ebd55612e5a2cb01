"""Cleaning, trends and column roles."""

import pytest
from pyspark.sql import functions as F

from tableprofile.operators import cleaning, questions, roles, trends
from tableprofile.plans.incidents import incidents


@pytest.fixture(scope="module")
def table(spark, folder):
    return incidents(spark, folder).cache()


def test_cleaning_twice_changes_nothing(table):
    once = cleaning.clean_dataset(table)
    twice = cleaning.clean_dataset(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert dict(once.dtypes)["lat"] == "double" and dict(once.dtypes)["hora"] == "string"


def test_cleaning_columns_are_found_by_name():
    found = cleaning.cleaning_columns(["Latitud", "LAT", "Longitud", "EDAD", "fecha", "Hora_Suceso", "hora"])
    assert found == {"latitude": "Latitud", "longitude": "Longitud", "age": "EDAD", "hour": "Hora_Suceso"}
    assert cleaning.cleaning_columns(["lon", "age"]) == {}


def test_rows_are_dropped_by_missing_values(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, None), (nan, None), (1.0, None), (1.0, "a"), (nan, "a")], "x double, y string")
    assert cleaning.drop_all_null_rows(df).count() == 3
    assert cleaning.drop_any_null_rows(df).count() == 1
    for drop_any in (False, True):
        row = cleaning.retention_report(df, "t", drop_any).first()
        assert row["final_rows"] == cleaning.clean_dataset(df, drop_any).count()
        assert row["percent"] == row["final_rows"] / 5 * 100
    assert cleaning.retention_report(df.limit(0), "t").first()["percent"] == 0.0


def test_locale_export_writes_decimal_commas(spark):
    df = spark.createDataFrame([("3,5", "-76,25", "23"), ("x", None, "40")], "lat string, long string, edad string")
    rows = cleaning.locale_export(cleaning.clean_dataset(df)).collect()
    assert [tuple(r) for r in rows] == [("3,5", "-76,25", "23,0"), (None, None, "40,0")]


def test_points_are_on_earth(spark):
    df = spark.createDataFrame([("90", "180"), ("-90,0", "-180"), ("90,1", "0"), ("inf", "0"), ("nan", "0"), (None, "1")], "a string, b string")
    assert trends.valid_points(df, "a", "b").count() == 2
    assert tuple(trends.points_coverage(df, "a", "b").first()) == (2, 6)


def test_trends_of_text_dates(spark):
    df = spark.createDataFrame([("2023-05-01",), ("2023-06-01",), ("2022-01-31",), ("?",), (None,)], "d string")
    assert [tuple(r) for r in trends.count_by_year(df, "d").collect()] == [(2022, 1), (2023, 2)]
    assert [tuple(r) for r in trends.count_by_month(df, "d").collect()] == [("2022-01", 1), ("2023-05", 1), ("2023-06", 1)]


@pytest.mark.parametrize(
    "columns, names, found",
    [
        (["Dirección"], ["direccion", "address"], "Dirección"),
        (["direcci_n"], ["direccion", "address"], "direcci_n"),
        (["dir"], ["direccion", "address"], None),
        (["x_direccion_y"], ["direccion", "address"], "x_direccion_y"),
        (["b", "zona", "area"], ["area", "zona"], "area"),
        (["AREA_KM", "Zona"], ["zona", "area"], "AREA_KM"),
        (["sexo"], ["longitud", "x"], None),
        (["X"], ["longitud", "x"], "X"),
        (["fecha_del_hecho"], ["fecha"], "fecha_del_hecho"),
        (["gener"], ["genero_victima"], "gener"),
        (["___"], ["zona"], None),
        ([], ["zona"], None),
    ],
)
def test_find_column(columns, names, found):
    assert roles.find_column(columns, names) == found


def test_role_breakdown_takes_the_first_role_present(spark):
    df = spark.createDataFrame([("leve",), ("leve",), ("grave",)], "severidad string")
    rows = [tuple(r) for r in roles.role_breakdown(df).collect()]
    assert rows == [("gravedad", "severidad", "leve", 2), ("gravedad", "severidad", "grave", 1)]
    assert roles.role_breakdown(spark.range(3)).count() == 0


def test_harmonised_tables_keep_all_rows(spark):
    a = spark.createDataFrame([("n", 1)], "Zona_A string, other int")
    b = spark.createDataFrame([("f",)], "genero string")
    both = roles.harmonise_columns({"a": a, "b": b}, roles.INCIDENT_ROLES)
    rows = {r["dataset"]: r for r in both.collect()}
    assert rows["a"]["zona"] == "n" and rows["a"]["genero"] is None and rows["b"]["genero"] == "f"


def test_questions_agree_with_each_other(table):
    share = questions.type_share(table, "clase_siniestro", "CLICK").first()
    year = questions.type_in_year(table, "clase_siniestro", "CLICK", "fecha", 2024).first()
    assert share["count"] == year["count"]
    groups = questions.age_groups(table).agg(F.sum("count")).first()[0]
    assert groups == questions.mean_age(table).first()["ages"]
    assert 0 <= int(questions.risk_hour(table).first()["value"]) < 24


def test_columns_with_odd_names(spark):
    df = spark.createDataFrame([("14;30", "3,5", "2024-01-02"), (None, None, None)], "`hora.x` string, `lat` string, `d.a te` string")
    assert [tuple(r) for r in cleaning.clean_dataset(df).collect()] == [("14:30", 3.5, "2024-01-02")]
    assert trends.count_by_year(df, "d.a te").first()["year"] == 2024
    assert questions.risk_hour(df, "hora.x").first()["value"] == "14"
    assert trends.points_coverage(df, "lat", "lat").first()["valid_points"] == 1
    assert roles.harmonise_columns({"a": df}, {"zeit": ["hora.x"]}).count() == 2
    assert cleaning.normalise_na(df).count() == 2
