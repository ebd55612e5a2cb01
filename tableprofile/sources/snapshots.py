"""Tables that readers can trust while they are written: snapshots behind a log."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.schema import union_aligned


class SnapshotConflict(RuntimeError):
    """Another job has written the next version first."""


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as the JVM knows them, so that any store of Spark's will do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, log = _hadoop(spark, f"{path}/log")
    if not files.exists(log):
        return []
    names = (status.getPath().getName() for status in files.listStatus(log))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _entry(spark: SparkSession, path: str, version: int) -> dict:
    """The folders and schemas that make up a version; a small file."""
    return json.loads(spark.read.text(f"{path}/log/{version:012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, version: int, entry: dict) -> None:
    """Write the log entry under a name of its own, then give it the version's, which only one job can."""
    files, target = _hadoop(spark, f"{path}/log/{version:012d}.json")
    _, staged = _hadoop(spark, f"{path}/log/.{uuid.uuid4().hex}")
    out = files.create(staged, False)
    try:
        out.write(bytearray(json.dumps(entry).encode()))
    finally:
        out.close()
    try:
        won = not files.exists(target) and files.rename(staged, target)
    except Py4JJavaError as e:
        raise SnapshotConflict(f"version {version} of {path}") from e
    if not won:
        files.delete(staged, False)
        raise SnapshotConflict(f"version {version} of {path}")


def write_snapshot(df: DataFrame, path: str, append: bool = False) -> int:
    """Write ``df`` as the next version of the table at ``path``, or add it to what is there.

    The data is written into a folder of its own first, rebalanced so that the number of
    files follows their size and not that of the tasks. Then one log entry makes it the
    current version. A reader sees the version before or this one, whole, and a job that
    breaks off leaves the table as it was. If another job has written the next version in
    the meantime, this raises ``SnapshotConflict`` and changes nothing.
    """
    spark = df.sparkSession
    versions = _versions(spark, path)
    parts = _entry(spark, path, versions[-1])["parts"] if append and versions else []
    version = versions[-1] + 1 if versions else 0
    folder = f"data/{version:012d}-{uuid.uuid4().hex}"
    df.hint("rebalance").write.parquet(f"{path}/{folder}")
    _commit(spark, path, version, {"parts": [*parts, {"folder": folder, "schema": df.schema.jsonValue()}]})
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, or as it is now; later writes do not change what was read.

    Parts that were written with other columns or types meet as in ``union_aligned``: an
    absent column is null, and a column that changed its kind is text.
    """
    versions = _versions(spark, path)
    if not versions or (version is not None and version not in versions):
        raise FileNotFoundError(f"no {'table' if version is None else f'version {version}'} at {path}")
    same: dict[str, list[str]] = {}
    for part in _entry(spark, path, versions[-1] if version is None else version)["parts"]:
        same.setdefault(json.dumps(part["schema"]), []).append(f"{path}/{part['folder']}")
    frames = [spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(*folders) for s, folders in same.items()]
    return frames[0] if len(frames) == 1 else union_aligned(frames)


def schema_log(spark: SparkSession, path: str) -> DataFrame:
    """(version, part, column, dtype): the columns of every part of every version."""
    rows = [
        (v, i, f.name, f.dataType.simpleString())
        for v in _versions(spark, path)
        for i, part in enumerate(_entry(spark, path, v)["parts"])
        for f in T.StructType.fromJson(part["schema"]).fields
    ]
    return spark.createDataFrame(rows, "version long, part int, column string, dtype string")


def expire_snapshots(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Forget all versions but the last ``keep``, and delete the folders that none of these needs."""
    versions = _versions(spark, path)
    kept, gone = versions[-keep:], versions[:-keep]
    needed = reduce(set.union, ({p["folder"] for p in _entry(spark, path, v)["parts"]} for v in kept), set())
    old = reduce(set.union, ({p["folder"] for p in _entry(spark, path, v)["parts"]} for v in gone), set())
    # The log first: no version is left that lacks a folder.
    for name in [f"log/{v:012d}.json" for v in gone] + sorted(old - needed):
        files, where = _hadoop(spark, f"{path}/{name}")
        files.delete(where, True)
    return len(gone)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the current version."""
    found = read_snapshot(spark, path).select("_metadata.file_path", "_metadata.file_size").distinct()
    return found.select(F.col("file_path").alias("file"), F.col("file_size").alias("bytes"))
