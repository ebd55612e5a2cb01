"""CSV that is split within quotes, and tables behind a log."""

import csv

import pytest
from pyspark.sql import functions as F

from tableprofile.sources import files, snapshots


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_found_across_splits(spark, tmp_path, small_splits, end):
    texts = ["plain", 'a "quoted" word', "line\nbreak", "\n", "x\n" * 150, '"', ",", "é, ü\n", "last\n\n\nline", ""]
    for name in ("one", "two"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["id", "some text", "n"])
            out.writerows([i, texts[(i * 7) % len(texts)], i / 2] for i in range(60))
    got = files.scan_csv_records(spark, str(tmp_path))
    assert got.columns == ["id", "some text", "n"] and [t for _, t in got.dtypes] == ["bigint", "string", "double"]
    want = [(i, texts[(i * 7) % len(texts)] or None, i / 2) for i in range(60)] * 2
    assert rows(got) == sorted(want, key=str)
    assert files.csv_records(spark, str(tmp_path)).rdd.getNumPartitions() > 0
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10
    assert rows(got) == rows(files.scan_csv(spark, str(tmp_path), multiline=True))


def test_a_schema_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿x,y\n1,2\nNA,bad\n")
    assert rows(files.scan_csv_records(spark, str(tmp_path), "y int, x long")) == [(2, 1), (None, None)]
    (tmp_path / "a.csv").write_text("x,y\n")
    assert rows(files.scan_csv_records(spark, str(tmp_path), "x long")) == []


def test_readers_see_one_version_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path)
    assert snapshots.write_snapshot(spark.range(10).toDF("a"), path) == 0
    before = snapshots.read_snapshot(spark, path)

    def breaks(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", breaks)
        with pytest.raises(RuntimeError):
            snapshots.write_snapshot(spark.range(3).toDF("a"), path)
    assert snapshots.read_snapshot(spark, path).count() == 10
    assert snapshots.write_snapshot(spark.range(5).select(F.col("id").cast("string").alias("a"), F.lit(1.5).alias("b")), path) == 1
    assert before.count() == 10 and snapshots.read_snapshot(spark, path).count() == 5  # the reader keeps its version
    assert snapshots.write_snapshot(spark.range(2).toDF("a"), path, append=True) == 2
    assert rows(snapshots.read_snapshot(spark, path)) == sorted([(str(i), 1.5) for i in range(5)] + [("0", None), ("1", None)], key=str)
    assert rows(snapshots.read_snapshot(spark, path, 0)) == [(i,) for i in range(10)]
    log = {(r.version, r.part, r.column): r.dtype for r in snapshots.schema_log(spark, path).collect()}
    assert log == {(0, 0, "a"): "bigint", (1, 0, "a"): "string", (1, 0, "b"): "double", (2, 0, "a"): "string", (2, 0, "b"): "double", (2, 1, "a"): "bigint"}
    assert snapshots.expire_snapshots(spark, path) == 2
    assert snapshots.read_snapshot(spark, path).count() == 7 and len(list((tmp_path / "table" / "data").iterdir())) >= 2
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, path, 0)


def test_the_second_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    snapshots.write_snapshot(spark.range(1), path)
    seen = snapshots._versions(spark, path)
    snapshots.write_snapshot(spark.range(2), path)
    monkeypatch.setattr(snapshots, "_versions", lambda *_: seen)
    with pytest.raises(snapshots.SnapshotConflict):
        snapshots.write_snapshot(spark.range(3), path)
    monkeypatch.undo()
    assert snapshots.read_snapshot(spark, path).count() == 2


def test_files_follow_the_size_of_the_data(spark, tmp_path):
    path = str(tmp_path / "table")
    snapshots.write_snapshot(spark.range(0, 1000, 1, 60), path)
    assert snapshots.file_sizes(spark, path).count() <= 2
