"""Similar documents by n-gram sets."""

import random
import re

import numpy as np
import pytest

from tableprofile.llm import common, ngram_join, quality
from tableprofile.llm.set_trie import similar

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sets_of(rows, k):
    out = {}
    for doc, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        out[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def components_of(sets, percent):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "İx", "A"]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, kept = [], []
    for doc in range(n):
        kind = rng.random()
        if kept and kind < 0.5:
            words = list(rng.choice(kept))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5, 10, 40, 120, 400]))]
            if kind > 0.8:
                words += passage
        kept.append(words)
        rows.append((doc, rng.choice([" ", "\t", " \n "]).join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, " \n ")]


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 90, 4000), (5, 80, 4000), (5, 80, 8), (3, 60, 6)])
def test_components_are_those_of_comparing_all_pairs(spark, k, percent, block):
    rows = corpus(k + percent)
    df = spark.createDataFrame([(d, t, 1, b"x") for d, t in rows], "doc_id long, text string, node int, set_id binary").repartition(3)
    sets = sets_of(rows, k)
    want = components_of(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df, k, percent, block_docs=block).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_rows_without_ids_repeated_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (3, text), (5, text), (4, "other words are here now"), (4, text + " more"), (None, text), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.ngram_join(df).collect()), key=str)
    assert got == sorted([(3, 46, 3), (3, 46, 3), (5, 46, 3), (4, 1, 3), (4, 47, 3), (0, 46, None), (0, 0, None)], key=str)
    assert ngram_join.ngram_join(df.limit(0)).count() == 0


def test_an_id_with_two_texts_links_by_both(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(7, one), (7, two), (3, one + " x"), (5, two + " x"), (9, one + " y")]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {3} and len(got) == 5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_share_sets_in_any_way(spark, seed):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "ABCDEFGH"]
    rows = [(3, texts[1]), (5, texts[0]), (7, texts[0]), (7, texts[1])]
    if seed > 1:
        rng = np.random.default_rng(seed)
        rows = [(int(rng.integers(0, 40)), texts[rng.integers(0, 8)] + " x" * int(rng.integers(0, 2))) for _ in range(14)]
    sets = sets_of([(i, t) for i, (_, t) in enumerate(rows)], 5)
    group = {d: d for d, _ in rows}
    for _ in rows:  # rows of one id, and rows with linked sets, are together
        for i, (a, _) in enumerate(rows):
            for j, (b, _) in enumerate(rows):
                if a == b or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    group[a] = group[b] = min(group[a], group[b])
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, group[d]) for d, _ in rows)


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_a_trie_joins_what_comparing_joins(percent):
    rng = np.random.default_rng(percent)
    base = [np.unique(rng.integers(0, 400, 100)) for _ in range(6)]
    sets = []
    for _ in range(120):
        own = set(base[rng.integers(0, 6)].tolist())
        for _ in range(rng.integers(0, 12)):
            own.discard(int(rng.integers(0, 400)))
            own.add(int(rng.integers(0, 400)))
        sets.append(np.array(sorted(own), np.uint64))
    want = components_of({i: set(s.tolist()) for i, s in enumerate(sets)}, percent)
    joined = similar(sets, list(range(120)), [True] * 120, percent)
    assert {i: joined.get(i, i) for i in range(120)} == want


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_a_key(percent):
    rng, parts = np.random.default_rng(1), ngram_join.Parts(percent)
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 5, 9, 20, 60, 200, 900]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        keep = a[rng.permutation(len(a))[: max(1, len(a) - rng.integers(0, 1 + len(a) // 6))]]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 6))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * len(np.union1d(a, b)):
            assert np.intersect1d(parts.of(a), parts.of(b)).size


def test_words_of_many_texts_are_hashed_a_little_at_a_time(monkeypatch):
    texts = [f"{i} b c d e f g {i % 7} ".encode() * 20 for i in range(20_000)]
    hashed = []

    def word_hashes(some):
        hashed.append(sum(map(len, some)))
        return common.word_hashes(some)

    monkeypatch.setattr(common, "_powers", [])
    for module, of in ((ngram_join, lambda t: ngram_join.ngram_sets(t, 5)), (quality, quality.features)):
        monkeypatch.setattr(module, "word_hashes", word_hashes)
        found = of(texts)
        assert all(np.array_equal(a, b) for a, b in zip(found[::999], [of([t])[0] for t in texts[::999]], strict=True))
    assert max(hashed) <= 1 << 18 and len(common._powers[0]) <= 1 << 19
