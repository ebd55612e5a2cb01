"""Nearest neighbours."""

import numpy as np
from pyspark.sql import functions as F

from tableprofile.llm import nearest

FIXTURE = "/root/testdata/sf0.01"


def brute(rows, queries, k):
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in queries:
        scores = vectors @ vectors[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_over_several_shards(spark):
    df = spark.read.parquet(f"{FIXTURE}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = result(nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0, shard_vectors=120))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)


def test_odd_vectors_copies_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [1.0, 0.0, 0.0]) for i in range(40)] + [(100, [3.0, 4.0, 0.0]), (120, [0.0, 0.0, 2.0]), (140, [-1.0, 0.0, 0.5])]
    odd = [(200, None), (220, [0.0] * 3), (240, [1.0, None, 0.0]), (260, [nan, 1.0, 0.0]), (280, [inf, 0.0, 0.0]), (300, [1.0] * 4), (None, [1.0] * 3)]
    repeated = [(100, [3.0, 4.0, 0.0]), (120, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + odd + repeated], "vec_id long, embedding array<float>, rank int")
    got = result(nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0))
    want = brute(good, [0, 20, 100, 120, 140], 20)
    assert got == want
    assert not result(nearest.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0))
    few = result(nearest.nearest_neighbours(df.where("vec_id IN (100, 120, 0)"), F.col("vec_id") == 0))
    assert [i for i, _ in few[0]] == [100, 120]


def test_large_components_keep_their_order(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (v * 10.0 ** rng.integers(18, 25)).tolist()) for i, v in enumerate(rng.normal(0, 1, (300, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = result(nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0)), brute(rows, range(0, 300, 20), 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
