"""Connected components of a graph whose edges do not fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end")
    nodes = edges.select(ends).groupBy("end.node").agg(F.sum("end.up").alias("up"), F.min("end.up").alias("least"))
    return nodes.where("up > 1 OR (up = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with edges (a, b).

    Rounds of large stars and small stars: every node hands its smallest neighbour to its
    larger neighbours, then to its smaller ones. Rounds grow with the logarithm of the
    nodes. Minima are aggregated in the map tasks first, written, and joined back: both sides
    of the join are shuffled for it alone, so it can split a node with very many edges.
    """
    now = stored(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label
    )
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = stored(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), label
        )
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
