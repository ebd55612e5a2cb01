"""What the operators share: stored tables, and words of a batch of texts as hashes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

# Fixed by the contracts of the operators: ASCII white space separates words.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
HASHED_BYTES = 1 << 18  # of texts whose words are hashed together; several numbers for each byte are held


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage: what follows survives lost executors without recomputing ``df``,
    and sees the same rows each time. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder of this package on the path of Python workers that have the same disk.

    On a cluster the package comes with ``--py-files``, and this adds nothing.
    """
    environment = spark.sparkContext.environment
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows a thousand at a time: what a worker holds besides a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with a function that imports this package."""
    let_workers_import(df.sparkSession)
    return df.mapInArrow(run, schema)


def texts_in_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``in_arrow`` for rows with whole texts, or sets of them: they travel about ``BATCH_BYTES`` at a time.

    Spark's batches, of 10,000 rows or 64 MB, are held beside the heap of an executor and again by
    each of its workers. The limit can only be set for the session; one that it has stays.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return in_arrow(df, run, schema)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to ``n``."""
    if not _powers or len(_powers[0]) < n:
        n = max(n + n // 4, 1 << 19)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for base in (_BASE, inverse):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``values[start:end]`` of 64-bit integers, whose place does not matter. No run is empty."""
    power, inverse = _tables(len(values))
    sums = np.cumsum((values + np.uint64(1)) * power[: len(values)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return mix((sums[ends - 1] - before) * inverse[starts])


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, where each text's words begin; one more at the end).

    A-Z are lower-cased, unless ``lower`` is False. A word's hash depends on its bytes alone.
    """
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    joined = _LOWER[joined] if lower else joined
    space = _IS_SPACE[joined]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    hashes = range_hashes(joined.astype(np.uint64), starts, ends)
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, begins)


def slices(texts: list[bytes], limit: int = 1 << 20):
    """(from, to) of runs of texts of about ``limit`` bytes each; a longer text is a run alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)
