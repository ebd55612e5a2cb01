"""Packing, URL lists, the registered queries and the pipeline."""

import hashlib
import itertools
import random
import sys
from datetime import UTC, datetime

import compare
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tableprofile.llm import exact_dedup, language_id, ngram_join, packing, quality, queries, url_filter


@pytest.mark.parametrize("seed", range(25))
def test_bounds_have_the_least_padding(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
    histogram = [(n, rng.randint(1, 9)) for n in lengths]
    for buckets in (1, 2, 3, 5, 12):
        got = packing.best_bounds(histogram, buckets)
        assert got[-1] == lengths[-1] and got == sorted(set(got)) and len(got) == min(buckets, len(lengths))
        padding = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in histogram)
        choices = itertools.combinations(lengths[:-1], len(got) - 1)
        assert padding(got) == min(padding((*c, lengths[-1])) for c in choices)


def test_batches_hold_all_rows_and_keep_the_budget(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 3, 40, 900])), "x") for i in range(300)] + [(5, "a b", "x"), (5, "a b", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slice string")
    got = packing.pack(df, buckets=4, batch_tokens=500).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((d or -1 if d != 0 else -1, len((t or "").split()) + 1) for d, t, _ in rows)
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for batch in batches.values():
        assert sorted(r.position for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or sum(r.bucket_tokens for r in batch) <= 500
    assert packing.pack(df.limit(0)).count() == 0


def test_very_many_rows_of_one_id_are_placed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 7)
    rows = [(None, "w " * (i % 3)) for i in range(500)] + [(9, "a b c")] * 100 + [(i, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, buckets=2, batch_tokens=40).collect()
    assert len(got) == 650 and sum(r.doc_id is None for r in got) == 500
    for bucket in {r.bucket for r in got}:
        own = [r for r in got if r.bucket == bucket]
        capacity = 40 // own[0].bucket_tokens
        assert sorted(r.batch * capacity + r.position for r in own) == list(range(len(own)))


def time(day):
    return datetime(2024, 1, day, tzinfo=UTC)


def test_lists_hold_as_of_the_fetch(spark):
    entries = [
        ("bad.com", "block", time(2)), ("bad.com", "remove", time(5)), ("bad.com", "block", time(9)), ("bad.com/ok", "allow", time(3)),
        ("bad.com", "block", time(2)), ("sub.bad.com", "allow", time(4)), (None, "block", time(1)), ("x.com", None, time(1)),
        ("tie.com", "allow", time(1)), ("tie.com", "block", time(1)),
    ]
    captures = [
        (1, "http://bad.com/a", time(1)), (2, "http://bad.com/a", time(2)), (3, "http://www.BAD.com:80/a", time(4)),
        (4, "http://bad.com/a", time(6)), (5, "http://bad.com/ok/b?x", time(9)), (6, "http://bad.com/okay", time(9)),
        (7, "http://u@sub.bad.com", time(9)), (8, "http://notbad.com/", time(9)), (9, None, time(9)), (10, "bad.com", time(9)),
        (11, "http://bad.com/a", None), (2, "http://bad.com/a", time(2)), (None, "https://tie.com/", time(3)),
    ]
    lists = spark.createDataFrame(entries, "pattern string, action string, dated_at timestamp")
    seen = spark.createDataFrame([(*c, 1) for c in captures], "page_id long, url string, fetched_at timestamp, action int")
    got = sorted((r.page_id or 0, r.blocked, r.pattern) for r in url_filter.filter_urls(seen, lists).collect())
    assert got == [
        (0, True, "tie.com"), (1, False, None), (2, True, "bad.com"), (3, True, "bad.com"), (4, False, None), (5, False, "bad.com/ok"),
        (6, True, "bad.com"), (7, False, "sub.bad.com"), (8, False, None), (9, False, None), (10, False, None), (11, False, None),
    ]
    assert url_filter.filter_urls(seen.limit(0), lists).count() == 0
    assert not any(r.blocked for r in url_filter.filter_urls(seen, lists.limit(0)).collect())


def test_far_dates_and_long_urls_cost_no_more(spark):
    lists = spark.createDataFrame([("bad.com", "block", time(2)), ("b.bad.com/x/y", "allow", time(2))], "pattern string, action string, dated_at timestamp")
    long = "http://a.b.bad.com/x/y" + "/z" * 100_000
    seen = spark.createDataFrame(
        [(1, long, time(3)), (2, "http://b.bad.com/x/y/z", datetime(9998, 1, 1, tzinfo=UTC)), (3, "http://" + "l." * 5000 + "bad.com", time(3)), (4, "http://bad.com", datetime(1, 2, 1, tzinfo=UTC))],
        "page_id long, url string, fetched_at timestamp",
    )
    got = url_filter.filter_urls(seen, lists)
    assert sorted((r.page_id, r.blocked, r.pattern) for r in got.collect()) == [(1, True, "bad.com"), (2, False, "b.bad.com/x/y"), (3, True, "bad.com"), (4, False, None)]
    keys = seen.select(F.size(url_filter._keys(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), 2, 2)))
    assert max(r[0] for r in keys.collect()) == 4


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_query_equals_checking_sql(spark, folder, name):
    assert compare.differences(queries.builders()[name](spark, folder), compare.connect(folder), queries.oracles()[name]) is None


def test_stages_do_what_their_operators_say(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.dtypes == docs.dtypes
        rows = {r.doc_id: r.text for r in docs.collect()}
        got = sorted(r.doc_id for r in out.collect())
        if k == 0:
            found = quality.score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 1")
            want = [r.doc_id for r in found.collect()]
        elif k == 1:
            want = [r.doc_id for r in language_id.label_languages(docs).collect() if r.lang_pred != "und" and r.score >= language_id.CLEAR_SCORE]
        elif k == 2:
            want = list({t: d for d, t in sorted(rows.items())}.values())
            assert want and exact_dedup.exact_dedup(docs).where("kept").count() == len(want)
        elif k == 3:
            want = [r.doc_id for r in ngram_join.ngram_join(docs, 5, 80).collect() if r.doc_id == r.component_id]
        else:
            want = list(rows)
        assert got == sorted(want)
        docs = out if k == 4 else spark.createDataFrame(out.collect(), out.schema)
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None


def test_stages_take_repeated_rows_and_nulls(spark, folder):
    rows = [(1, "one text here", None, None, None), (1, "one text here", "en", "s", 1), (2, "one text here", "en", "s", 1), (None, None, None, None, None), (None, "one text here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_copies(spark, docs, folder)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (2, "one text here")]
    assert corpus_pipeline.without_near_copies(spark, docs.limit(0), folder).count() == 0
    assert hashlib.sha256(b"").hexdigest() in {r.text_sha256 for r in exact_dedup.exact_dedup(docs).collect()}
    assert corpus_pipeline.packed(spark, docs, folder).agg(F.count(F.lit(1))).first()[0] == 5


def test_near_copies_of_repeated_and_missing_ids(spark, folder):
    first, second, other = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    near = first + " more"
    rows = [(7, first), (7, second), (3, near), (5, other), (5, other + " more"), (None, second + " more"), (None, "alone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {tuple(r) for r in corpus_pipeline.without_near_copies(spark, docs, folder).collect()}
    assert {(7, second), (3, near), (None, "alone"), (None, None)} <= kept
    assert len(kept) == 5 and len([r for r in kept if r[0] == 5]) == 1
