"""Repeated passages against a dictionary of all windows."""

import hashlib
import random

import compare
import pytest

from tableprofile.llm import queries, substring_dedup

SCHEMA = "doc_id long, text string, start string, tag string, seed string"


def brute(rows, n=20):
    seen, out = set(), []
    for doc, text in sorted({(d, t or "") for d, t in rows}, key=lambda r: r[0] if r[0] is not None else -(10**9)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - n + 1):
            window = tuple(words[s : s + n])
            if window in seen:
                gone[s : s + n] = [True] * n
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = substring_dedup.remove_repeats(df, **sizes).collect()
    for r in got:
        assert sum(s.end - s.start for s in r.repeats) == r.n_removed
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (19, 20, 21, 35, 60, 200)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(4)):
            words += prose(rng, rng.randrange(0, 25)) + rng.choice(passages)[rng.randrange(3) :]
        if i % 5 == 0 and rows:  # a near copy
            words = rng.choice(rows)[1].split()
            for _ in range(3):
                if words:
                    words[rng.randrange(len(words))] = "changed"
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(-1, "a " * 500), (-2, "a b " * 60), (-3, " ".join(["x"] * 19)), (-4, " ".join(["x"] * 20)), (-5, "x " * 41)]
    rows += [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, " \n "), (None, " ".join(passages[3])), (-6, "ü 中文 " * 30)]
    rng.shuffle(rows)
    return list(dict(rows).items())


@pytest.mark.parametrize("words", [20, 5, 1])
def test_passages_near_copies_periods_and_odd_rows(spark, words):
    rows = corpus(words)
    want = brute(rows, words)
    assert sum(r[2] for r in want) > 2000
    assert found(spark, rows, words=words) == want


def test_one_passage_in_every_document(spark):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(i, " ".join(prose(rng, 10) + passage + prose(rng, 10))) for i in range(400)]
    assert found(spark, rows) == brute(rows)


def test_repeated_rows_and_ids_and_no_rows(spark):
    text, other = " ".join(map(str, range(30))), " ".join(map(str, range(5, 40)))
    assert found(spark, [(1, text), (1, text), (2, other)]) == brute([(1, text), (2, other)])
    two = found(spark, [(1, text), (1, other), (None, text), (None, text)])
    assert [r[:2] for r in two] == [(1, 30), (1, 35), (None, 30)] and [r[2] for r in two] == [30, 25, 0]
    assert found(spark, []) == []


def test_query_equals_checking_sql(spark, folder):
    df = queries.builders()["op12_substring_dedup"](spark, folder)
    assert compare.differences(df, compare.connect(folder), queries.oracles()["op12_substring_dedup"]) is None
