"""Nearest neighbours by inner product, from a small-world graph per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column
from .common import in_arrow, let_workers_import, stored

SHARD_VECTORS = 8192
QUERY_BLOCK = 1024
LINKS = 16  # of a node on an upper level; twice as many on the lowest
EF_BUILD = 80
EF_SEARCH = 160
SEED = 5


class Graph:
    """A hierarchical navigable small world over the rows of ``vectors``.

    ``links[0]`` has a row of neighbours for each vector, -1 where there are fewer.
    ``links[l]`` has one for each of ``nodes[l]``, the vectors that reach level ``l``.

    For the search by largest inner product, vectors get one more component that makes all
    of one length, and queries a zero: then nearer means a larger product.
    """

    def __init__(self, vectors: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray], entry: int):
        # Of one scale, so that no product leaves the range of its type; no order depends on it.
        vectors = vectors / (np.abs(vectors).max(initial=0) or 1)
        squares = (vectors.astype(np.float64) ** 2).sum(1)
        extra = np.sqrt(np.maximum(0, (squares.max() if len(squares) else 0) - squares))
        self._points = np.concatenate([vectors, extra[:, None]], 1).astype(np.float32)
        self.nodes, self.links, self.entry = nodes, links, entry
        self._place = [None]
        for own in nodes[1:]:
            place = np.full(len(vectors), -1, np.int32)
            place[own] = np.arange(len(own))
            self._place.append(place)
        self._seen = np.zeros(len(vectors), np.int64)
        self._round = 0

    def _row(self, node: int, level: int) -> np.ndarray:
        return self.links[level][node if level == 0 else self._place[level][node]]

    def _search_level(self, point: np.ndarray, entries: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ``ef`` nodes found nearest to ``point``, as (product, node), nearest first."""
        self._round += 1
        seen, now = self._seen, self._round
        for _, node in entries:
            seen[node] = now
        best = list(entries)  # the farthest first
        heapq.heapify(best)
        todo = [(-s, node) for s, node in entries]
        heapq.heapify(todo)
        while todo:
            s, node = heapq.heappop(todo)
            if len(best) >= ef and -s < best[0][0]:
                break
            near = self._row(node, level)
            near = near[near >= 0]
            near = near[seen[near] != now]
            if not len(near):
                continue
            seen[near] = now
            products = self._points[near] @ point
            if len(best) >= ef:
                closer = products > best[0][0]
                near, products = near[closer], products[closer]
            for product, other in zip(products.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (product, other))
                elif product > best[0][0]:
                    heapq.heapreplace(best, (product, other))
                else:
                    continue
                heapq.heappush(todo, (-product, other))
        return sorted(best, key=lambda x: (-x[0], x[1]))

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions first: a candidate nearer to a chosen one than to the node waits."""
        if len(found) <= most:
            return [node for _, node in found]
        ids = [node for _, node in found]
        points = self._points[ids]
        among = points @ points.T
        chosen, waiting, closest = [], [], np.full(len(ids), -np.inf, np.float32)
        for i, (product, _) in enumerate(found):
            if closest[i] <= product:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.maximum(closest, among[i], out=closest)
            else:
                waiting.append(i)
        return [ids[i] for i in (chosen + waiting)[:most]]

    def _connect(self, node: int, to: list[int], level: int) -> None:
        row = self._row(node, level)
        row[: len(to)] = to
        for other in to:
            theirs = self._row(other, level)
            free = np.flatnonzero(theirs < 0)
            if len(free):
                theirs[free[0]] = node
                continue
            around = np.append(theirs, node)
            products = self._points[around] @ self._points[other]
            order = np.argsort(-products, kind="stable")
            kept = self._spread([(float(products[i]), int(around[i])) for i in order], len(theirs))
            theirs[:] = -1
            theirs[: len(kept)] = kept

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """Insert the vectors one by one."""
        n, rng = len(vectors), np.random.default_rng(SEED)
        levels = np.minimum(8, (-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int))
        nodes = [np.flatnonzero(levels >= level).astype(np.int32) for level in range(int(levels.max()) + 1)]
        links = [np.full((len(own), LINKS if level else 2 * LINKS), -1, np.int32) for level, own in enumerate(nodes)]
        graph = cls(vectors, nodes, links, 0)
        top = int(levels[0])
        for node in range(1, n):
            point = graph._points[node]
            found = [(float(graph._points[graph.entry] @ point), graph.entry)]
            for level in range(top, -1, -1):
                found = graph._search_level(point, found, EF_BUILD if level <= levels[node] else 1, level)
                if level <= levels[node]:
                    graph._connect(node, graph._spread(found, LINKS), level)
            if levels[node] > top:
                top, graph.entry = int(levels[node]), node
        return graph

    def nearest(self, query: np.ndarray, ef: int) -> list[int]:
        """About ``ef`` vectors with the largest products with ``query``."""
        point = np.append(query / (np.abs(query).max(initial=0) or 1), 0).astype(np.float32)
        found = [(float(self._points[self.entry] @ point), self.entry)]
        for level in range(len(self.links) - 1, -1, -1):
            if level and self._place[level][found[0][1]] < 0:
                continue
            found = self._search_level(point, found, ef if level == 0 else 1, level)
        return [node for _, node in found]


_INDEX = "shard int, vectors binary, id_ends binary, ids binary, nodes array<binary>, links array<binary>, entry int"


def _index_shard(table: pa.Table) -> pa.Table:
    """One shard's graph as flat arrays."""
    vectors = np.array(table.column("vector").to_pylist(), np.float64)
    lists = table.column("ids").to_pylist()
    graph = Graph.build(vectors)
    row = {
        "shard": table.column("shard")[0].as_py(),
        "vectors": vectors.tobytes(),
        "id_ends": np.cumsum([0, *map(len, lists)]).astype(np.int64).tobytes(),
        "ids": np.array([i for ids in lists for i in sorted(ids)], np.int64).tobytes(),
        "nodes": [a.tobytes() for a in graph.nodes],
        "links": [a.tobytes() for a in graph.links],
        "entry": graph.entry,
    }
    types = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int32()]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def index_vectors(vectors: DataFrame, k: int, shard_vectors: int = SHARD_VECTORS) -> tuple[DataFrame, int]:
    """The table of shard graphs, and their number. ``vectors``: (vec_id, vector), one row an id.

    Equal vectors are one node with the ``k`` + 1 smallest of their ids: no other of them can
    be among the ``k`` nearest of anything. A shard is a hash range of the vectors.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = vectors.select("vec_id", "vector", rank.alias("rank")).where(F.col("rank") <= k + 1)
    nodes = stored(few.groupBy("vector").agg(F.collect_list("vec_id").alias("ids")), "vectors")
    shards = max(1, -(-nodes.count() // shard_vectors))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    let_workers_import(vectors.sparkSession)
    return stored(dealt.groupBy("shard").applyInArrow(_index_shard, _INDEX), "index"), shards


def nearest_neighbours(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    ef: int = EF_SEARCH,
    shard_vectors: int = SHARD_VECTORS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` others found with the largest inner product.

    ``is_query`` is a condition on ``vec_id``. Every block of queries visits every shard, and
    the shards' results are merged. Scores are products of the original vectors in double
    precision; equal scores are ordered by id. A query is no candidate of its own; if there
    are fewer candidates than ``k``, all are returned.

    Rows without an id, and vectors that are null, zero, hold a null or non-finite component
    or have another length than most take no part. Of several rows with one id, that with
    the smallest vector takes part. Other columns are not looked at.
    """
    rows = df.select(column(key).cast("long").alias("vec_id"), column(vector).cast("array<double>").alias("vector"))
    usable = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    usual = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    usable = usable.where(F.size("vector") == (usual["size"] if usual else 0))
    vectors = stored(usable.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    index, shards = index_vectors(vectors, k, shard_vectors)
    queries = vectors.where(is_query)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    in_blocks = (
        queries.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
        .agg(F.collect_list("vec_id").alias("query_ids"), F.flatten(F.collect_list("vector")).alias("queries"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                id_ends, ids = np.frombuffer(row["id_ends"], np.int64), np.frombuffer(row["ids"], np.int64)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(id_ends) - 1, -1)
                nodes = [np.frombuffer(a, np.int32) for a in row["nodes"]]
                links = [np.frombuffer(a, np.int32).reshape(len(n), -1) for a, n in zip(row["links"], nodes, strict=True)]
                graph = Graph(vectors, nodes, links, row["entry"])
                out = [[], [], []]
                for query_id, query in zip(row["query_ids"], np.reshape(row["queries"], (len(row["query_ids"]), -1)), strict=True):
                    found = np.array(graph.nearest(query, max(ef, k + 1)))
                    counts = id_ends[found + 1] - id_ends[found]
                    scores = np.repeat((vectors[found] * query).sum(1), counts)
                    others = np.concatenate([ids[id_ends[f] : id_ends[f + 1]] for f in found])
                    scores, others = scores[others != query_id], others[others != query_id]
                    best = np.lexsort((others, -scores))[:k]
                    out[0] += [query_id] * len(best)
                    out[1] += others[best].tolist()
                    out[2] += scores[best].tolist()
                types = [pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out, types, strict=True)], ["query_id", "vec_id", "score"]
                )

    found = in_arrow(in_blocks.join(index, "shard"), run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
