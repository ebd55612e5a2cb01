"""Ingesting landed datasets: scan, clean, write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import clean_dataset
from ..operators.schema import union_aligned
from .files import scan_csv, scan_json_records, write_table


def folder_name(dataset: str) -> str:
    """Folder of a dataset: lower case, spaces and hyphens as underscores."""
    return dataset.lower().replace(" ", "_").replace("-", "_")


def ingest_dataset(
    spark: SparkSession,
    path: str,
    name: str,
    out_dir: str,
    limit: int | None = None,
    drop_any: bool = False,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    counts: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Scan landed JSON records, clean them, write them, and return the written table.

    One narrow job without a shuffle; a ``schema`` saves the scan that infers one. The
    write replaces what an earlier run left, also where the source is empty now.
    ``counts``, if given, gets the rows scanned and the rows kept by dataset name, from the
    job that writes.
    """
    scanned, kept = Observation(), Observation()
    raw = scan_json_records(spark, path, limit, schema).observe(scanned, F.count(F.lit(1)).alias("rows"))
    cleaned = clean_dataset(raw, drop_any).observe(kept, F.count(F.lit(1)).alias("rows"))
    target = write_table(cleaned, f"{out_dir.rstrip('/')}/{folder_name(name)}", fmt)
    if counts is not None:
        counts[name] = scanned.get["rows"], kept.get["rows"]
    if fmt == "csv":
        return scan_csv(spark, target, cleaned.schema)
    return spark.read.schema(cleaned.schema).format(fmt).load(target)


def ingest_all(
    spark: SparkSession,
    datasets: Mapping[str, str],
    out_dir: str,
    limit: int | None = None,
    drop_any: bool = False,
    counts: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Ingest every dataset and return them as one table with the column ``dataset``.

    A column that is text in one dataset and something else in another is text.
    """
    return union_aligned(
        [
            ingest_dataset(spark, path, name, out_dir, limit, drop_any, counts=counts).withColumn("dataset", F.lit(name))
            for name, path in datasets.items()
        ]
    )


def ingest_retention(
    spark: SparkSession, datasets: Mapping[str, str], out_dir: str, drop_any: bool = False
) -> DataFrame:
    """(dataset, rows, kept, percent): what cleaning keeps of each dataset while it is ingested."""
    counts: dict[str, tuple[int, int]] = {}
    ingest_all(spark, datasets, out_dir, drop_any=drop_any, counts=counts)
    rows = [F.struct(F.lit(n).alias("dataset"), F.lit(a).cast("long").alias("rows"), F.lit(b).cast("long").alias("kept")) for n, (a, b) in counts.items()]
    percent = F.try_divide("kept", "rows") * 100
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows))).withColumn("percent", percent)
