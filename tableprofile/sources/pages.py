"""Page texts of document files, by an injected extractor."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import batched

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.documents import PAGES_PER_PART, assemble_pages, good_text
from ..session import scratch_path

# Pages that a worker hands back at a time.
PAGES_PER_BATCH = 2000
# Or so many characters, if that is less: pages may be long.
CHARS_PER_BATCH = 1 << 22
# Files that one run of an incremental job reads; what it did is then known for good.
FILES_PER_RUN = 10_000

Extractor = Callable[[bytes], Iterable[tuple[int, str]]]


def _binary(spark: SparkSession, glob: str = "*") -> DataFrameReader:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)


def _described(files: DataFrame) -> list[Column]:
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("stem")
    return [files.path, F.col("modificationTime").alias("modified"), files.length, stem]


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, length, stem, content) of every file below a folder."""
    files = _binary(spark, glob).load(path)
    return files.select(*_described(files), "content")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, length, stem) of every file below a folder that is not empty; no content is read."""
    files = _binary(spark, glob).load(path)
    return files.select(*_described(files))


def extract_pages(files: DataFrame, extractor: Extractor, key: str | Sequence[str] = "stem") -> DataFrame:
    """(key, page_no, text, error): the pages of each file, one file at a time per task.

    A file that the extractor fails on gives one row without text, so that a fallback
    can take it up and the other files go on; pages that came before the failure stay.
    Pages are handed on while a file is read. ``key`` is a column or several.
    """
    keys = [key] if isinstance(key, str) else list(key)
    schema = T.StructType(
        [
            *(files.schema[k] for k in keys),
            T.StructField("page_no", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("error", T.StringType()),
        ]
    )

    def as_batch(files: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        places, numbers, texts, errors = zip(*rows) if rows else ((), (), (), ())
        names = [files.column(k).take(pa.array(places, pa.int64())) for k in keys]
        values = [pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays([*names, *values], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            chars = 0
            for i in range(batch.num_rows):
                try:
                    # Of the files of a batch, one is taken out of it at a time.
                    for number, text in extractor(bytes(batch.column("content")[i].as_py())):
                        rows.append((i, number, text, None))
                        chars += len(text or "")
                        if len(rows) >= PAGES_PER_BATCH or chars >= CHARS_PER_BATCH:
                            yield as_batch(batch, rows)
                            rows, chars = [], 0
                except Exception as e:  # noqa: BLE001 - any failure of the injected function
                    rows.append((i, None, None, f"{type(e).__name__}: {e}"))
            yield as_batch(batch, rows)

    return files.select(*keys, "content").mapInArrow(run, schema)


def _identity(files: DataFrame, key: str) -> list[str]:
    """What tells one version of a file from another: its place, time and length where they are known."""
    return [c for c in ("path", "modified", "length") if c in files.columns] or [key]


def incremental_extract(files: DataFrame, cache_path: str, extractor: Extractor, key: str = "stem") -> DataFrame:
    """(key, ..., page_no, text): pages of all files, extracting only those that the cache does not have.

    A file is known by its path, modification time and length (as ``scan_files`` gives them;
    else by ``key``), so files of one name in two folders stay apart and a changed file is
    read again. Pages are appended to the cache with the number of the run; then a manifest
    lists the files that the run has finished, those without pages too. Pages of a run that
    broke off are in no manifest and are never read. Files that failed are tried again.
    """
    spark, identity = files.sparkSession, _identity(files, key)
    columns = list(dict.fromkeys([*identity, key]))
    manifest_path, pages_path, run = f"{cache_path}/manifest", f"{cache_path}/pages", f"run-{uuid.uuid4().hex}"
    try:
        todo = files.join(spark.read.parquet(manifest_path).select(*identity), identity, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        todo = files
    extract_pages(todo, extractor, columns).write.parquet(f"{pages_path}/run={run}")
    failed = spark.read.parquet(f"{pages_path}/run={run}").where(F.col("error").isNotNull())
    done = todo.select(*identity).distinct().join(failed.select(*identity).distinct(), identity, "left_anti")
    done.withColumn("run", F.lit(run)).write.mode("append").parquet(manifest_path)
    current = spark.read.parquet(manifest_path).join(files.select(*identity).distinct(), identity, "left_semi")
    pages = spark.read.parquet(pages_path).join(current, [*identity, "run"], "left_semi")
    return pages.select(*columns, "page_no", "text")


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


FILE_IDENTITY = ("path", "modified", "length")
_PAGES = "path string, page_no long, text string, error string, run string"


def extract_new_files(
    listed: DataFrame, cache_path: str, extractor: Extractor, files_per_run: int = FILES_PER_RUN
) -> DataFrame:
    """(path, modified, length, stem, page_no, text): pages of all listed files, reading only files that are new.

    ``listed`` comes from ``list_files``: what a file is known by is compared with the
    cache's manifest before any content is read. The new files are then read in runs of
    ``files_per_run``. A run is named by its files, and replaces what a broken run of that
    name left; when it is over, a manifest row for each of its files says so. So a job that
    broke off goes on where it was, and repeating it reads no file twice. A file that
    changed is read again and its old pages are no longer returned; files that failed are
    tried again.
    """
    spark, identity = listed.sparkSession, list(FILE_IDENTITY)
    manifest_path, pages_path = f"{cache_path}/manifest", f"{cache_path}/pages"
    listed = listed.select(*identity, "stem")
    known = _read_or_none(spark, manifest_path)
    todo = listed if known is None else listed.join(known, identity, "left_anti")
    # Paths of one run at a time are held here.
    for files in batched(todo.select(*identity).orderBy("path").toLocalIterator(), files_per_run):
        _extract_run(spark, files, manifest_path, pages_path, extractor)
    known, pages = _read_or_none(spark, manifest_path), _read_or_none(spark, pages_path)
    if known is None or pages is None:
        return listed.where(F.lit(False)).select("*", F.lit(None).cast("long").alias("page_no"), F.lit(None).cast("string").alias("text"))
    current = listed.join(known, identity)
    return pages.where("error IS NULL").select("path", "run", "page_no", "text").join(current, ["path", "run"]).select(*listed.columns, "page_no", "text")


def _extract_run(spark: SparkSession, files: Sequence[Row], manifest_path: str, pages_path: str, extractor: Extractor) -> None:
    run = "run-" + hashlib.sha256("\n".join(f"{f.path} {f.modified} {f.length}" for f in files).encode()).hexdigest()[:32]
    # Characters that would make a path a pattern stand for themselves.
    paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", f.path) for f in files]
    pages = extract_pages(_binary(spark).load(paths).select("path", "content"), extractor, "path")
    pages.write.mode("overwrite").parquet(f"{pages_path}/run={run}")
    failed = spark.read.schema(_PAGES).parquet(f"{pages_path}/run={run}").where(F.col("error").isNotNull()).select("path")
    done = spark.createDataFrame(list(files), "path string, modified timestamp, length long").join(failed, "path", "left_anti")
    done.write.mode("overwrite").parquet(f"{manifest_path}/run={run}")


def extract_new_documents(
    listed: DataFrame,
    cache_path: str,
    primary: Extractor,
    fallback: Extractor,
    pages_per_part: int = PAGES_PER_PART,
    files_per_run: int = FILES_PER_RUN,
) -> DataFrame:
    """(path, part_no, n_pages, chars, text, method): ``extract_documents`` for listed files, from and to a cache.

    Content is read once by the primary extractor, and once more by the fallback only for
    files whose primary text is too short, that failed or that have no pages.
    """
    spark = listed.sparkSession
    pages = extract_new_files(listed, f"{cache_path}/primary", primary, files_per_run)
    path = scratch_path(spark, "primary-text")
    assemble_pages(pages, "path", "page_no", pages_per_part=pages_per_part).write.parquet(path)
    parts = spark.read.parquet(path)
    good = parts.where((F.col("part_no") > 0) | good_text(F.col("text"))).select("path").distinct()
    rest = listed.join(good, "path", "left_anti")
    again = extract_new_files(rest, f"{cache_path}/fallback", fallback, files_per_run)
    replaced = assemble_pages(again, "path", "page_no", pages_per_part=pages_per_part)
    return (
        parts.join(good, "path", "left_semi")
        .withColumn("method", F.lit("primary"))
        .unionByName(replaced.withColumn("method", F.lit("fallback")))
    )


def extract_documents(
    files: DataFrame, primary: Extractor, fallback: Extractor, key: str = "stem", pages_per_part: int = PAGES_PER_PART
) -> DataFrame:
    """(key, part_no, n_pages, chars, text, method): assembled documents, the costly way only where needed.

    Files whose primary text is too short, that failed or that have no pages go to the
    fallback, whose text stays as it is. Primary text is written first, so it is made once.
    """
    spark = files.sparkSession
    path = scratch_path(spark, "primary-text")
    readable = extract_pages(files, primary, key)
    assemble_pages(readable, key, "page_no", pages_per_part=pages_per_part).write.parquet(path)
    parts = spark.read.parquet(path)
    good = parts.where((F.col("part_no") > 0) | good_text(F.col("text"))).select(key).distinct()
    rest = files.join(good, key, "left_anti")
    again = assemble_pages(extract_pages(rest, fallback, key), key, "page_no", pages_per_part=pages_per_part)
    return (
        parts.join(good, key, "left_semi")
        .withColumn("method", F.lit("primary"))
        .unionByName(again.withColumn("method", F.lit("fallback")))
    )
