"""Name, DataFrame function and checking SQL of every registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]

_BUILDERS: dict[str, Build] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a function of (spark, folder), with the SQL to check it by, if any."""

    def register(build: Build) -> Build:
        if name in _BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return register


def builders() -> dict[str, Build]:
    return dict(_BUILDERS)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
