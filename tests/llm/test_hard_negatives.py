"""Hard negatives against all pairs in Python's integers."""

import math

import numpy as np
from pyspark.sql import functions as F

from tableprofile.llm import hard_negatives as hn

NAN, INF = float("nan"), float("inf")


def brute(rows):
    """Rows of the contract from (vec_id, embedding, label)."""
    by_id = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * x) for x in v]
        own = (label + 1) % 10 if i % 7 == 0 else label
        by_id[i] = min(by_id.get(i, (own, ints)), (own, ints))
    out = set()
    for a, (label, v) in by_id.items():
        if a % 100:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in by_id.items() if i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if by_id[i][0] == label][:5]:
            near = [i for i in order if by_id[i][0] != label and 30 * scores[p] <= 100 * scores[i] <= 90 * scores[p]]
            out |= {(a, p, rank, i, scores[p], scores[i]) for rank, i in enumerate(near[:10], 1)}
    return out


def found(df, **sizes):
    return {tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 100 == 0, hn.contract_label(), **sizes).collect()}


def table(spark, rows):
    return spark.createDataFrame(
        [(i, v, label, "x", 1) for i, v, label in rows],
        "vec_id long, embedding array<double>, label int, block string, rank int",
    )


def test_products_are_exact_for_any_size():
    rng = np.random.default_rng(1)
    for width, most in ((64, 256), (200, 1 << 20), (3, 1 << 29), (0, 1), (70, 1)):
        a, b = (rng.integers(-most, most + 1, (n, width)) for n in (7, 11))
        a[0], b[0] = most, -most
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert hn.products(a, b).tolist() == want


def test_all_pairs_with_many_blocks_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(0, 0.3, (700, 12))
    vectors[100:300] = vectors[100]  # a group of copies
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(vectors)]
    rows += [(-100, [0.5] * 12, 1), (-7, [1000.0] * 12, 9), (1000, [], 1), (1100, [3000.0], 2), (1200, [0.1] * 20, 0)]
    rows += [(1300, None, 1), (1400, [0.0, None], 1), (1500, [NAN], 1), (1600, [INF], 1), (1700, [1.0], None), (None, [1.0], 1)]
    rows += [(200, [0.2] * 12, 1), (200, [0.2] * 12, 1), (3, [0.9] * 12, 0)]
    df = table(spark, rows)
    want = brute(rows)
    assert len(want) > 300
    assert found(df, block_rows=50, anchor_rows=3) == want
    assert found(df) == want


def test_few_and_no_rows(spark):
    assert found(table(spark, [])) == set()
    assert found(table(spark, [(5, [1.0], 1)])) == set()
    few = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 9.0], 2), (3, [0.95, 0.0], 2)]
    assert found(table(spark, few)) == brute(few) == {(100, 1, 1, 2, 65536, 32768)}
