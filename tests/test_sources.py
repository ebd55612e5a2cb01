"""Round trips through files."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tableprofile.sources import datasets, files, pages


def test_csv_types_and_na_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        '﻿whole,number,flag,text,empty,dates,mixed,big\n'
        '1,1.5,True,a,,2020-01-01,1,99999999999999999999\n'
        'NA,2,false,"b, ""c""",n/a,2020-01-02,x,1\n'
        ' 3 ,inf,TRUE,None,NULL,,NaN,2\n',
        encoding="utf-8",
    )
    df = files.scan_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {
        "whole": "bigint", "number": "double", "flag": "boolean", "text": "string", "empty": "double",
        "dates": "string", "mixed": "string", "big": "double",
    }
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == (1, 1.5, True, "a", None, "2020-01-01", "1", 1e20)
    assert rows[1] == (None, 2.0, False, 'b, "c"', None, "2020-01-02", "x", 1.0)
    assert rows[2] == (3, float("inf"), True, None, None, None, None, 2.0)
    typed = files.scan_csv(spark, str(tmp_path), "whole int, mixed int")
    assert [tuple(r) for r in typed.collect()] == [(1, 1), (None, None), (3, None)]


def test_missing_paths_raise(spark, tmp_path):
    with pytest.raises(AnalysisException):
        files.scan_csv(spark, str(tmp_path / "none"))
    with pytest.raises(AnalysisException):
        files.scan_json_records(spark, str(tmp_path / "none"))


def test_text_survives_the_csv_sink(spark, tmp_path):
    rows = [(1, 'quote " and, comma'), (2, " spaces "), (3, "back\\slash"), (4, None), (5, "line\nbreak")]
    df = spark.createDataFrame(rows, "id int, t string")
    path = files.write_table(df, str(tmp_path / "out"), "csv")
    files.write_table(df, str(tmp_path / "out"), "csv")  # a second run replaces the first
    assert sorted(tuple(r) for r in files.scan_csv(spark, path, multiline=True).collect()) == rows


def test_json_records_with_varying_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": "1", "y": "a"},\n {"x": "2", "z": "b"}]')
    df = files.scan_json_records(spark, str(tmp_path), multiline=True)
    assert sorted(tuple(r) for r in df.select("x", "y", "z").collect()) == [("1", "a", None), ("2", None, "b")]
    assert files.scan_json_records(spark, str(tmp_path), limit=1, multiline=True).count() == 1
    (tmp_path / "b.json").write_text("<html>")
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        files.scan_json_records(spark, str(tmp_path), multiline=True, schema="x string").collect()


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_ingest_writes_a_clean_table(spark, tmp_path, fmt):
    (tmp_path / "in.json").write_text('{"lat": "3,5", "hora": "14;30"}\n{"lat": "x", "hora": "310"}\n{"lat": null}\n')
    df = datasets.ingest_dataset(spark, str(tmp_path / "in.json"), "City data-2024", str(tmp_path / "out"), fmt=fmt)
    assert sorted(tuple(r) for r in df.select("hora", "lat").collect()) == [("03:10", None), ("14:30", 3.5)]
    assert (tmp_path / "out" / "city_data_2024").is_dir()
    strict = datasets.ingest_dataset(spark, str(tmp_path / "in.json"), "strict", str(tmp_path / "out"), drop_any=True)
    assert strict.count() == 2


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_an_empty_source_replaces_what_was_there(spark, tmp_path, fmt):
    source, counts = tmp_path / "in.json", {}
    for text, rows in (('{"lat": "3"}\n{"lat": null}\n', 1), ('{"lat": null}\n', 0)):
        source.write_text(text)
        df = datasets.ingest_dataset(spark, str(source), "city", str(tmp_path / "out"), fmt=fmt, schema="lat string", counts=counts)
        assert df.count() == rows
    assert counts == {"city": (1, 0)}


def test_columns_of_different_types_meet_as_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"zone": "A1", "n": 1}\n')
    (tmp_path / "b.json").write_text('{"zone": 12, "n": 1.5}\n')
    paths = {name: str(tmp_path / f"{name}.json") for name in "ab"}
    got = datasets.ingest_all(spark, paths, str(tmp_path / "out")).select("dataset", "zone", "n").collect()
    assert sorted(map(tuple, got)) == [("a", "A1", 1.0), ("b", "12", 1.5)]


def _extractor():
    def extract(content: bytes):
        text = content.decode("utf-8")
        return list(enumerate(text.split("\f"), start=1))

    return extract


def test_pages_of_files(spark, tmp_path):
    (tmp_path / "a.b.txt").write_bytes("one\ftwo".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "skip.md").write_bytes(b"x")
    scanned = pages.scan_files(spark, str(tmp_path), "*.txt")
    rows = {(r["stem"], r["page_no"]): (r["text"], r["error"]) for r in pages.extract_pages(scanned, _extractor()).collect()}
    assert rows["a.b", 1] == ("one", None) and rows["a.b", 2] == ("two", None)
    assert rows["bad", None][0] is None and "UnicodeDecodeError" in rows["bad", None][1]
    assert len(rows) == 3


def test_only_new_files_are_extracted(spark, tmp_path):
    cache = str(tmp_path / "cache")
    first = spark.createDataFrame([("a", b"1\f2"), ("bad", b"\xff")], "stem string, content binary")
    assert pages.incremental_extract(first, cache, _extractor()).count() == 2

    def refuse_known(content: bytes):
        if content == b"1\f2":
            raise AssertionError("extracted again")
        return [(1, "new")]

    second = first.unionByName(spark.createDataFrame([("c", b"x")], "stem string, content binary"))
    got = sorted((r["stem"], r["page_no"], r["text"]) for r in pages.incremental_extract(second, cache, refuse_known).collect())
    assert got == [("a", 1, "1"), ("a", 2, "2"), ("bad", 1, "new"), ("c", 1, "new")]
    assert pages.incremental_extract(first.where("stem = 'a'"), cache, refuse_known).count() == 2


def test_files_are_known_by_path_time_and_length(spark, tmp_path):
    import os

    cache, folder = str(tmp_path / "cache"), tmp_path / "files"
    calls = tmp_path / "calls"

    def extractor():
        def extract(content: bytes):
            with open(calls, "a") as log:
                log.write("x")
            return [(i, t) for i, t in enumerate(content.decode().split("\f"), 1) if t]

        return extract

    def run():
        before = len(calls.read_text()) if calls.exists() else 0
        rows = pages.incremental_extract(pages.scan_files(spark, str(folder)), cache, extractor()).collect()
        return sorted((r["path"][-7:], r["page_no"], r["text"]) for r in rows), len(calls.read_text()) - before

    for name in ("x", "y"):
        (folder / name).mkdir(parents=True)
    (folder / "x" / "r.txt").write_text("1\f2")
    (folder / "x" / "e.txt").write_text("\f")
    assert run() == ([("x/r.txt", 1, "1"), ("x/r.txt", 2, "2")], 2)
    (folder / "y" / "r.txt").write_text("3\f4")
    assert run() == ([("x/r.txt", 1, "1"), ("x/r.txt", 2, "2"), ("y/r.txt", 1, "3"), ("y/r.txt", 2, "4")], 1)
    (folder / "x" / "r.txt").write_text("new")
    os.utime(folder / "x" / "r.txt", (2_000_000_000, 2_000_000_000))
    assert run() == ([("x/r.txt", 1, "new"), ("y/r.txt", 1, "3"), ("y/r.txt", 2, "4")], 1)
    assert run()[1] == 0


def test_documents_take_the_fallback_where_needed(spark):
    rows = [("long", b"t" * 200), ("short", b"t"), ("bad", b"\xff"), ("none", b"")]
    files_ = spark.createDataFrame(rows, "stem string, content binary")

    def primary():
        def extract(content: bytes):
            text = content.decode()
            return [(1, text)] if text else []

        return extract

    def fallback():
        return lambda content: [(1, "again")]

    got = {r["stem"]: (r["method"], r["text"][-5:]) for r in pages.extract_documents(files_, primary(), fallback()).collect()}
    assert got == {"long": ("primary", "ttttt"), "short": ("fallback", "again"), "bad": ("fallback", "again"), "none": ("fallback", "again")}


def test_scratch_paths_are_fresh_and_below_the_named_folder(spark):
    from tableprofile.session import CHECKPOINT_CONF, LOCAL_SCRATCH, scratch_path

    first, second = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert first != second
    assert first.startswith(spark.conf.get(CHECKPOINT_CONF, LOCAL_SCRATCH))
