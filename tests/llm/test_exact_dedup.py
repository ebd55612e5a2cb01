"""Exact duplicates."""

import pytest
from pyspark.sql import functions as F

from tableprofile.llm import exact_dedup

SCHEMA = "doc_id long, text string, hash int, key string, level int"


def found(df, **kw):
    return {(r.doc_id, r.text_sha256): r for r in exact_dedup.exact_dedup(df, **kw).collect()}


def groups_of(rows):
    distinct = {(d, t or "") for d, t in rows}
    texts = {}
    for d, t in distinct:
        texts.setdefault(t, []).append(d)
    return {(d, t): (max((x for x in texts[t] if x is not None), default=None), len(texts[t])) for d, t in distinct}


def test_names_tell_texts_apart_like_comparing_them(spark):
    base = "abcdefgh" * 5
    rows = [
        (1, base), (2, base), (3, base[:-1]), (4, base + "x"), (5, ""), (6, None), (7, None), (None, base), (None, "alone"),
        (8, "abcdefgh"), (9, "abcdefghabcdefgh"), (10, "é" * 9), (11, "é" * 9), (12, base), (12, base), (13, "one"), (13, "two"),
        (14, base * 40), (15, base * 40), (16, base * 39 + base[::-1]),
    ]
    df = spark.createDataFrame([(d, t, 1, "k", 2) for d, t in rows], SCHEMA)
    import hashlib

    want = {(d, hashlib.sha256(t.encode()).hexdigest()): v for (d, t), v in groups_of(rows).items()}
    got = found(df, block_bytes=8)
    assert {k: (r.keep_id, r.group_size) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.values())


def test_hashes_that_clash_do_not_join_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(i, t) for i, t in enumerate(["a" * 30, "b" * 30, "a" * 30, "a" * 8, "b" * 8, "a" * 16, "c" * 31])]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=8)
    assert sorted((r.doc_id, r.keep_id) for r in got.values()) == [(0, 2), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)]


def test_an_empty_table_gives_no_rows(spark):
    assert not found(spark.createDataFrame([], SCHEMA))


@pytest.mark.parametrize("part", ["Python", "Pandas", "Arrow"])
def test_the_plan_is_native(spark, folder, part):
    df = exact_dedup.exact_dedup(spark.read.parquet(f"{folder}/documents.parquet"))
    assert part not in df._jdf.queryExecution().executedPlan().toString()
