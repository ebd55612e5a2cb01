"""Quality, language and language model: held-out results, gradients and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprofile.llm import language_id, language_model, ngram_join, quality
from tableprofile.llm.gru import ColumnGru, Gru

FIXTURE = "/root/testdata/sf0.01"


def crc(doc, folds):
    return zlib.crc32(str(doc).encode()) % folds


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FIXTURE}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FIXTURE}/labels.parquet")


def test_gradients_are_those_of_small_steps():
    rng = np.random.default_rng(3)
    gru = Gru(rng.normal(0, 1, (5, 9)), rng.normal(0, 1, (3, 9)))
    ids, keep = rng.integers(0, 5, (6, 4)), (rng.random((6, 4)) > 0.3).astype(float)
    start, weights = rng.normal(0, 1, (4, 3)), rng.normal(0, 1, (6, 4, 3))

    def loss():
        return float((gru.run(ids, start, keep)[0] * weights).sum())

    kept = gru.run(ids, start, keep)[1]
    for array, gradient in zip((gru.inputs, gru.states), gru.gradients(ids, kept, weights, keep), strict=True):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in array.shape)
            old = array[at]
            array[at] = old + 1e-5
            up = loss()
            array[at] = old - 1e-5
            down = loss()
            array[at] = old
            assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=2e-3)


def test_held_out_quality(docs, labels):
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (crc(d, 5) == 0) and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if crc(r.doc_id, 5) == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert quality.keep_good(docs, labels).count() == sum(r.predicted for r in got.values())


def test_quality_of_odd_rows(spark, docs, labels):
    rows = [(1, None, 7), (2, "", 7), (None, "some text", 7), (3, "word " * 200_000, 7), (3, "word " * 200_000, 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = quality.score_quality(odd, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(odd.limit(0), labels).count() == 0


def test_held_out_languages(spark, docs):
    got = {r.doc_id: r for r in language_id.label_languages(docs).collect()}
    assert all(r.held_out == (crc(d, 3) == 1) for d, r in got.items()) and len(got) == docs.count()
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.select("doc_id", "lang").collect() if crc(r.doc_id, 3) == 1]
    assert np.mean([a == b for a, b in held]) > 0.95
    rows = [(1, None, "en", 0), (2, "", "en", 0), (3, "12 ... 34", "en", 0), (None, "the and of", None, 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = sorted(language_id.label_languages(odd).collect(), key=lambda r: str(r.doc_id))
    assert [(r.lang_pred, r.score) for r in got[:3]] == [("und", 0.0)] * 3
    assert language_id.label_languages(odd.limit(0)).count() == language_id.keep_clear(odd.limit(0)).count() == 0
    unknown = language_id.label_languages(odd.where("doc_id IS NULL")).collect()
    assert [(r.lang_pred, r.held_out) for r in unknown] == [("und", False)]


def test_every_byte_has_a_label_and_words_are_remembered():
    rng = np.random.default_rng(0)
    network = language_id.ByteNetwork.random(["a", "b"], rng)
    words = [b"x", b"abc", b"q" * 32, "é".encode()]
    at_bytes = network.at_bytes(words)
    assert [len(p) for p in at_bytes] == [1, 3, 32, 2]
    assert np.allclose(network.sums(words), [p.sum(0) for p in at_bytes], atol=1e-4)
    labeller = language_id.Labeller(network)
    first = labeller.pooled(["abc é 12 abc", "", "x"])
    want = (2 * at_bytes[1].sum(0) + at_bytes[3].sum(0)) / 8
    assert np.allclose(first[0], want, atol=1e-5) and not first[1].any()
    assert np.allclose(labeller.pooled(["x", "abc é 12 abc"]), first[[2, 0]])


def test_language_model_counts_and_held_out_gain(spark, docs):
    rows = [(-1, None, 0), (-2, "", 0), (None, "the the", 0), (-3, "The\tTHE É\x0bé", 0), (-3, "The\tTHE É\x0bé", 0), (-4, "of " * 20_000, 0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    every = docs.select("doc_id", "text", "n_chars").unionByName(odd)
    counts = Counter()
    table = [(r.doc_id, language_model.tokens_of((r.text or "").encode())) for r in every.collect()]
    for doc, tokens in table:
        if doc is not None and crc(doc, 10):
            counts.update(tokens)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for doc, tokens in table:
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        held = doc is not None and crc(doc, 10) == 0
        want[doc, held, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 4)] += 1
    got = language_model.score_texts(every).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens + 0.2
    assert language_model.score_texts(every.limit(0)).count() == 0


def test_probabilities_add_up_to_one():
    places = {w.encode(): i for i, w in enumerate(["", "a", "b", "c", "d", "e"])}
    words = language_model.Words(100, 20, places, np.log10([30.0, 20, 10, 9, 5, 4]), {"x": 0}, np.log10([9.0, 3.0]), 6)
    model = language_model.WordModel.random(words)
    states = np.random.default_rng(0).normal(0, 1, (4, language_model.HIDDEN)).astype(np.float32)
    total = sum(np.exp(model.log_probabilities(states, np.full(4, t))[0]) for t in range(8))
    assert np.allclose(total, 1, atol=1e-5)
    document = np.array([1, 2, 7, 3, 0] * 40)
    alone = model.score([document])[0]
    assert np.allclose(model.score([document[:3], document, document[:50]])[1], alone, rtol=1e-5)


@pytest.fixture()
def small_model():
    places = {w.encode(): i for i, w in enumerate(["", "a", "b", "c", "d", "e"])}
    words = language_model.Words(100, 20, places, np.log10([30.0, 20, 10, 9, 5, 4]), {"x": 0}, np.log10([9.0, 3.0]), 6)
    return language_model.WordModel.random(words)


@pytest.mark.parametrize("sizes", [[1], [7] * 50, [1, 30, 90] * 67, [20_000], [5] * 200 + [9_000] + [5] * 20, []])
def test_every_token_is_learnt_from(small_model, sizes):
    rng = np.random.default_rng(1)
    before = {k: v.copy() for k, v in small_model.arrays.items()}
    assert small_model.train(iter([rng.integers(0, 8, n) for n in sizes]), 0.003) == sum(sizes)
    assert any((small_model.arrays[k] != before[k]).any() for k in before) == bool(sizes)


def test_what_is_behind_the_end_of_a_stream_changes_nothing(small_model):
    found = []
    for padding in (0, 5):
        given = []
        adam = type("Kept", (), {"step": lambda self, g, given=given: given.append(g)})()
        ids, keep = np.array([[1, 2], [3, 7], [4, 0]]), np.ones((3, 2), np.float32)
        ids = np.concatenate([ids, np.full((padding, 2), 5)])
        keep = np.concatenate([keep, np.ones((padding, 2), np.float32)])
        h = np.full((2, language_model.HIDDEN), 0.1, np.float32)
        small_model._train_window(adam, ids, keep, h, np.array([3, 3]), 6)
        found += given
    assert all(np.allclose(found[0][k], found[1][k], atol=1e-6) for k in found[0])


def test_a_corpus_of_long_documents_is_learnt(spark):
    pattern = "one two three four five six seven eight nine ten " * 700  # 35 KB
    texts = spark.createDataFrame([(i, pattern) for i in range(20)], "doc_id long, text string").coalesce(1)
    got = language_model.score_texts(texts).collect()
    assert sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) > 0.5
    assert language_model._first_tokens(b"A b") == [b"a", b"b", b""]
    long = b"ab " * language_model.FIRST_DOC_BYTES
    assert set(language_model._first_tokens(long[: language_model.FIRST_DOC_BYTES + 1])) == {b"ab"}


def test_every_training_document_is_learnt_from(spark, monkeypatch):
    rows = [(i, f"w{i % 7} x y z") for i in range(400)]
    learnt = []
    monkeypatch.setattr(language_model, "stored", lambda df, label, kept=language_model.stored: learnt.append((label, out := kept(df, label))) or out)
    language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).count()
    seen = sum(r.seen for r in dict(learnt)["trained"].select("seen").collect())
    assert seen == 5 * sum(crc(i, 10) != 0 for i in range(400))


def test_without_a_known_language_texts_with_letters_stay(spark):
    rows = [(1, "some text", None), (2, "12 ... 34", None), (3, None, None), (4, "", None), (5, "12 é", None)]
    unknown = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language_id.keep_clear(unknown).collect()) == [1, 5]


def test_a_language_of_long_documents_alone_is_learnt(spark):
    rows = [(i, ("the house and water " if i % 2 else "дом вода река ") * (2 if i % 2 else 2000), "en" if i % 2 else "ru") for i in range(60)]
    got = language_id.label_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in rows}
    pieces = spark.createDataFrame([("a" * 9 + " " * 2 + "b" * 40_000 + " end",)], "t string").select(language_id._pieces(language_id.F.col("t"))).first()[0]
    assert len(pieces) == language_id.PIECES and pieces[0].startswith("a" * 9) and pieces[-1].endswith("b end")
    assert language_id._words(["x one two y", "z"]) == ["one", "two", "z"] and language_id._words(["A b"]) == ["a", "b"]


def test_a_repeated_id_is_learnt_from_once(spark, monkeypatch):
    ids = [i for i in range(100) if crc(i, 3) != 1]
    rows = [(ids[0], "one two three", "en")] * 500 + [(i, "four five", "en") for i in ids[1:4]]
    learnt = []
    monkeypatch.setattr(language_id.ByteNetwork, "train", lambda self, words, labels, rng: learnt.extend(words))
    assert language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")) is not None
    assert len(learnt) == 3 + 3 * 2


def test_samples_take_one_row_of_an_id(spark, monkeypatch):
    ids = [i for i in range(60) if crc(i, 5) and crc(i, 10)]
    rows = [(ids[0], f"text {k % 3}") for k in range(300)] + [(i, "some other text") for i in ids[1:]]
    repeated = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1)] * 20 + [(ids[1], 1), (ids[2], 0)], "doc_id long, quality int")
    found = []
    monkeypatch.setattr(quality.Classifier, "fit", lambda p, u, prior: found.append((len(p), len(u))))
    quality.fit(repeated, labels)
    assert found == [(2, len(ids))]
    first = []
    monkeypatch.setattr(language_model.WordModel, "train", lambda self, documents, rate, streams: first.append(len(list(documents))))
    counts = language_model.count_tokens(repeated).cache()
    monkeypatch.setattr(language_model, "stored", lambda df, label: df.limit(0))
    language_model.fit(repeated, language_model.know_words(counts))
    assert first == [len(ids)] * 2


def test_columns_give_what_rows_give():
    rng = np.random.default_rng(5)
    inputs, states = rng.normal(0, 1, (5, 9)), rng.normal(0, 1, (3, 9))
    ids, keep = rng.integers(0, 5, (6, 4)), (rng.random((6, 4)) > 0.3).astype(float)
    start, weights = rng.normal(0, 1, (4, 3)), rng.normal(0, 1, (6, 4, 3))
    rows, columns = Gru(inputs, states), ColumnGru(inputs, states)
    after, kept = rows.run(ids, start, keep)
    found, found_kept = columns.run(ids, start, keep)
    assert np.allclose(found, after)
    for a, b in zip(columns.gradients(ids, found_kept, weights, keep), rows.gradients(ids, kept, weights, keep), strict=True):
        assert np.allclose(a, b)
    before, last = columns.before(ids, start, keep)
    assert np.allclose(before, [k[0] for k in kept]) and np.allclose(last, after[-1])


def test_tokens_of_several_texts_are_numbered_at_once(small_model):
    places = {w: i for i, w in enumerate([b"", b"a", b"b", b"c", b"d", b"e"])}
    texts = [b" A b\tzx  a", b"", b"  ", b"zx zx q c", "\u00c9x \u00e9".encode(), b"e " * 5]
    for placed, frequent in ((places, 4), ({}, 0)):
        words = language_model.Words(100, 20, placed, np.zeros(len(placed)), {"zx": 0, "x": 1}, np.zeros(3), frequent)
        numbers, found, upto, (rows, others) = language_model._Numbers(words).of_slice(texts)
        tokens = [language_model.tokens_of(t) for t in texts]
        assert upto.tolist() == np.cumsum([len(t) for t in tokens]).tolist()
        flat = [(i, w) for i, own in enumerate(tokens) for w in own]
        assert found.tolist() == [placed.get(w, -1) for _, w in flat]
        tails = {"zx": 0, "x": 1}
        want = [placed[w] if placed.get(w, frequent) < frequent else frequent + tails.get(w.decode()[-2:], 2) for _, w in flat]
        assert numbers.tolist() == want
        assert list(zip(rows.tolist(), others.to_pylist())) == [(i, w.decode()) for i, w in flat if w not in placed]


def test_a_task_adds_up_its_words_before_it_hands_them_on(spark, monkeypatch):
    texts = [(i, " ".join(f"w{k}" for k in range(i % 3, 60))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    handed = []
    kept = language_model.in_arrow
    monkeypatch.setattr(language_model, "in_arrow", lambda *args: handed.append(kept(*args)) or handed[-1])
    monkeypatch.setattr(language_model, "TEXT_BYTES", 500)
    want = Counter(w for _, t in texts for w in language_model.tokens_of(t.encode()))
    assert {bytes(r.word): r.c for r in language_model.count_tokens(docs).collect()} == want
    assert handed[0].count() == len(want)


def test_a_shared_beginning_is_gone_through_once(monkeypatch):
    network = language_id.ByteNetwork.random(["a", "b", "c"], np.random.default_rng(0))
    words = [b"begin" + bytes([97 + i % 26, 97 + i // 26]) for i in range(200)] + [b"\0", b"\0\0", b"begin", b"q" * 32, b"begin"]
    want = [p.sum(0) for p in network.at_bytes(words)]
    seen = []
    step = language_id.ColumnGru.step_columns
    monkeypatch.setattr(language_id.ColumnGru, "step_columns", lambda self, gates, *args: seen.append(gates.shape[1]) or step(self, gates, *args))
    assert np.allclose(network.sums(words), want, atol=1e-4)
    assert sum(seen) < 0.6 * 2 * sum(map(len, words))
    monkeypatch.setattr(language_id, "BYTES_AT_ONCE", 50)
    monkeypatch.setattr(language_id, "ROWS_AT_ONCE", 3)
    assert np.allclose(network.sums(words), want, atol=1e-4)


def test_words_that_come_again_stay_in_memory(monkeypatch):
    monkeypatch.setattr(language_id, "CACHE_WORDS", 40)
    monkeypatch.setattr(language_id, "GROUP_WORDS", 20)
    network = language_id.ByteNetwork.random(["a", "b"], np.random.default_rng(0))
    learnt = Counter()
    learn = language_id.Labeller._learn
    monkeypatch.setattr(language_id.Labeller, "_learn", lambda self, words: learnt.update(words) or learn(self, words))
    texts = [f"often {'l' * 40}é w{i} x{i} often {i}" for i in range(100)]
    found = language_id.Labeller(network).pooled(texts)
    assert learnt["often"] == learnt["l" * 40 + "é"] == 1 and len(learnt) == 302
    at = network.at_bytes([b"often", b"l" * 32, b"l" * 8 + "é".encode()])
    for i in (0, 57, 99):
        own = network.at_bytes([f"w{i}".encode(), f"x{i}".encode()])
        sums = 2 * at[0].sum(0) + sum(p.sum(0) for p in [*at[1:], *own])
        assert np.allclose(found[i], sums / (10 + 42 + sum(map(len, own))), atol=1e-5)


def test_texts_travel_a_few_megabytes_at_a_time(spark, monkeypatch):
    def checked(batches, rows=1000):
        for batch in batches:
            assert batch.nbytes < 5 << 20, batch.nbytes
            yield batch

    for module in (quality, language_id, ngram_join):
        monkeypatch.setattr(module, "small_batches", checked)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 25_000)
    docs = spark.range(200).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.expr("CAST(NULL AS STRING)").alias("lang"))
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    spark.conf.unset(limit)
    for found in (quality.keep_good(docs, labels), language_id.keep_clear(docs), ngram_join.ngram_join(docs)):
        assert found.count() == 200
    # A limit that the session sets itself stays.
    spark.conf.set(limit, "1m")
    quality.keep_good(docs, labels)
    assert spark.conf.get(limit) == "1m"
    spark.conf.unset(limit)
