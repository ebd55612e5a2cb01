"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# For sessions of one process that name no shared folder, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "tableprofile") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``.

    All executors must see what a job writes, so the cluster names the folder. Only a
    session on one machine that names none gets ``LOCAL_SCRATCH``.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/tableprofile/{label}-{uuid.uuid4().hex}"
