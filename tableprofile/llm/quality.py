"""Text quality, learnt from trusted positives and unlabelled text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import column
from .common import HASHED_BYTES, mix, slices, small_batches, texts_in_arrow, word_hashes
from .gru import Adam, sigmoid
from .samples import fold, sample

# The fit takes at most so many documents.
POSITIVES = 6000
UNLABELLED = 12000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN = 16
EPOCHS = 40
BATCH = 512

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASSES = np.zeros(256, np.int64)  # upper, lower, digit, space, line end, above ASCII, other, punctuation one by one
_CLASSES[:] = 6
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58], _CLASSES[32], _CLASSES[10], _CLASSES[128:] = 0, 1, 2, 3, 4, 5
_CLASSES[_PUNCTUATION] = np.arange(7, 7 + len(_PUNCTUATION))
_N_CLASSES = 7 + len(_PUNCTUATION)
N_FEATURES = _N_CLASSES + 8


def _share(part: np.ndarray | float, whole: float) -> np.ndarray | float:
    return part / whole if whole else part * 0.0


def features(texts: list[bytes]) -> np.ndarray:
    """Shares of bytes by kind, sizes, and how much words, word pairs and lines repeat, per text."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for start, end in slices(texts, HASHED_BYTES):
        words, ends = word_hashes(texts[start:end])
        for row, text, a, b in zip(range(start, end), texts[start:end], ends, ends[1:], strict=False):
            kinds = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=_N_CLASSES)
            own, n = words[a:b], int(b - a)
            pairs = mix(own[1:] + mix(own[:-1]))
            lines = [line for line in text.split(b"\n") if line.strip()]
            counts = np.unique(own, return_counts=True)[1] if n else np.zeros(1)
            out[row, :_N_CLASSES] = np.sqrt(_share(kinds, len(text)))
            out[row, _N_CLASSES:] = (
                np.log1p(len(text)),
                np.log1p(n),
                np.log1p(_share(float(len(text)), n)),
                _share(float(len(counts)), np.sqrt(n)) / 10 if n else 0.0,
                _share(float((own[1:] == own[:-1]).sum()), n),
                _share(float(len(pairs) - len(np.unique(pairs))), n),
                _share(float(counts.max()), n),
                _share(float(len(lines) - len(set(lines))), len(lines)),
            )
    return out


class Classifier:
    """One hidden layer over standardised features."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, arrays: dict[str, np.ndarray]):
        self.mean, self.spread, self.arrays = mean, spread, arrays

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def _raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.arrays
        hidden = np.tanh(x @ w["in"] + w["in_bias"])
        return hidden, hidden @ w["out"] + w["out_bias"][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._raw(self._standard(x))[1].astype(np.float64))

    def _gradients(self, x: np.ndarray, d_raw: np.ndarray, hidden: np.ndarray) -> dict[str, np.ndarray]:
        w = self.arrays
        d_hidden = d_raw[:, None] * w["out"] * (1 - hidden * hidden)
        return {"in": x.T @ d_hidden, "in_bias": d_hidden.sum(0), "out": hidden.T @ d_raw, "out_bias": d_raw.sum(keepdims=True)}

    @classmethod
    def fit(cls, positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> Classifier:
        """Minimise the non-negative unbiased risk.

        With the loss l(y, f) = s(-y f), the risk of calling negatives positive is that of
        the unlabelled rows, R_u, less what the positives among them add, ``prior`` R_p-. It
        cannot be negative: where a batch makes it so, the step goes the other way on this
        part, which takes back overfitting.
        """
        rng = np.random.default_rng(seed)
        everything = np.concatenate([positive, unlabelled])
        arrays = {
            "in": rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)).astype(np.float32),
            "in_bias": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        model = cls(everything.mean(0), everything.std(0) + 1e-3, arrays)
        positive, unlabelled = model._standard(positive), model._standard(unlabelled)
        steps = Adam(arrays, 0.01)
        for epoch in range(EPOCHS):
            steps.rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
            p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
            for at in range(0, len(unlabelled), BATCH):
                p = positive[p_order[np.arange(at, at + BATCH) % len(positive)]]
                u = unlabelled[u_order[at : at + BATCH]]
                (hidden_p, raw_p), (hidden_u, raw_u) = model._raw(p), model._raw(u)
                s_p, s_u = sigmoid(raw_p), sigmoid(raw_u)
                slope_p, slope_u = s_p * (1 - s_p) / len(p), s_u * (1 - s_u) / len(u)
                if s_u.mean() - prior * s_p.mean() >= 0:
                    d_p, d_u = -2 * prior * slope_p, slope_u
                else:
                    d_p, d_u = prior * slope_p, -slope_u
                g_p, g_u = model._gradients(p, d_p, hidden_p), model._gradients(u, d_u, hidden_u)
                steps.step({k: g_p[k] + g_u[k] + 1e-5 * arrays[k] for k in arrays})
        return model


def _binary(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    return [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]


def _features_of(docs: DataFrame, keys: DataFrame) -> np.ndarray:
    """Features of the documents with the given ids, of which there are few; one row for each id.

    Repeated rows of an id meet as one in the map tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = pa.array(list(features(_binary(batch))), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "x"])

    every = texts_in_arrow(docs.join(F.broadcast(keys), "doc_id").select("doc_id", "text"), run, "doc_id long, x array<float>")
    rows = every.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").toArrow()
    found = rows.column("x").combine_chunks()
    return found.flatten().to_numpy().reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Classifier | None:
    """A classifier from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality); None without positives.

    The trusted positives are at most ``POSITIVES`` documents with label 1; the unlabelled
    text is at most ``UNLABELLED`` of all documents, whose labels are not looked at. Both
    come from the folds that may be learnt from. ``prior`` is the share of positives in web
    text; unless given, it is the share of 1 among the labels of those folds.
    """
    learnt = fold(F.col("doc_id"), FOLDS) != 0
    known = labels.where(learnt & F.col("quality").isNotNull())
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quality").cast("long")).alias("ones")).first()
    ids = docs.where(learnt).select("doc_id").distinct()
    total = ids.count()
    if not counts["ones"] or not total:
        return None
    if prior is None:
        prior = min(0.99, max(0.01, counts["ones"] / counts["n"]))
    positives = known.where("quality = 1").select("doc_id").distinct()
    positive = _features_of(docs, sample(positives, "doc_id", POSITIVES, positives.count()))
    unlabelled = _features_of(docs, sample(ids, "doc_id", UNLABELLED, total))
    return Classifier.fit(positive, unlabelled, prior) if len(positive) else None


def _model(df: DataFrame, labels: DataFrame, doc: str, text: str) -> Classifier | None:
    docs = df.select(column(doc).cast("long").alias("doc_id"), column(text).alias("text"))
    return fit(docs, labels.select(column(doc).cast("long").alias("doc_id"), "quality"))


def _scores(model: Classifier | None, batch: pa.RecordBatch, text: str) -> np.ndarray:
    texts = _binary(batch, text)
    return model.score(features(texts)) if model else np.full(len(texts), 0.5)


def score_quality(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``df``.

    A null text is an empty one. Repeated rows are scored alike. Rows without an id are
    scored, but not learnt from. Without a positive label to learn from, every score is
    0.5. Columns other than the id and the text are not looked at.
    """
    model = _model(df, labels, doc, text)
    docs = df.select(column(doc).cast("long").alias("doc_id"), column(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            scores = pa.array(_scores(model, batch, "text"), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])

    return texts_in_arrow(docs, run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``score_quality`` predicts 1 for, as they are. No row is moved."""
    model = _model(df, labels, doc, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(_scores(model, batch, text) >= THRESHOLD))

    return texts_in_arrow(df, run, df.schema)
