"""Sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling
from .registry import query, read

_ORDER = "md5(CAST(o_orderkey AS VARCHAR) || '|42')"


def _stratified(category: str, size: int = 500) -> str:
    return f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
    n / least(n, quota) AS sample_weight FROM (
    SELECT *, row_number() OVER (PARTITION BY {category} ORDER BY {_ORDER}, o_orderkey) AS rnk,
      count(*) OVER (PARTITION BY {category}) AS n,
      (SELECT greatest(1, {size} // count(DISTINCT {category})) FROM orders) AS quota
    FROM orders WHERE {category} IS NOT NULL) WHERE rnk <= quota"""


_STRATIFIED = _stratified("o_orderstatus")


@query("random_sample", f"SELECT * FROM orders ORDER BY {_ORDER}, o_orderkey LIMIT 500")
def random_sample(spark, folder):
    return sampling.random_sample(read(spark, folder, "orders"), "o_orderkey")


@query("stratified_sample", _STRATIFIED)
def stratified_sample(spark, folder):
    return sampling.stratified_sample(read(spark, folder, "orders"), "o_orderkey")


@query("stratified_sample_many", _stratified("o_orderdate", 40))
def stratified_sample_many(spark, folder):
    """More strata than rows wanted: each keeps one."""
    return sampling.stratified_sample(read(spark, folder, "orders"), "o_orderkey", "o_orderdate", size=40)


@query(
    "sample_coverage",
    f"""SELECT (SELECT count(*) FROM orders) AS "rows", count(*) AS sample_rows,
    round(count(*) / (SELECT count(*) FROM orders) * 100, 6) AS percent FROM ({_STRATIFIED})""",
)
def sample_coverage(spark, folder):
    orders = read(spark, folder, "orders")
    coverage = sampling.sample_coverage(orders, sampling.stratified_sample(orders, "o_orderkey"))
    return coverage.withColumn("percent", F.round("percent", 6))
