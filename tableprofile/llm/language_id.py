"""Language of a text, from a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column
from .common import slices, small_batches, texts_in_arrow
from .gru import Adam, ColumnGru, Gru
from .samples import fold

FOLDS = 3
HELD_OUT = 1
UNDETERMINED = "und"
# The fit takes at most so many documents of a language, those of at most so many bytes first,
# and so many documents in all. Of a longer one it takes pieces spread over the whole text.
DOCS_PER_LANGUAGE = 400
DOC_BYTES = 16_384
PIECES = 16
DOCS = 4_000
HIDDEN = 12
SPAN = 32  # bytes that the network sees at once; words beyond it are cut
ROWS = 512  # of a training step
STEPS = 500
CLEAR_SCORE = 0.4  # mixed texts of two languages score more, noise less
CACHE_WORDS = 1 << 18
GROUP_WORDS = 1 << 17  # looked up together
BYTES_AT_ONCE = 1 << 19  # of words that the network goes through together
ROWS_AT_ONCE = 2048  # of a step, so that they stay near the processor
SEED = 7


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes by place and word, lengths); 0 beyond a word's end."""
    lengths = np.array([len(w) for w in words])
    ids = np.zeros((int(lengths.max()), len(words)), np.intp)
    inside = np.arange(len(ids))[None, :] < lengths[:, None]
    ids.T[inside] = np.frombuffer(b"".join(words), np.uint8)
    return ids, lengths


def _turned(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each word's places from its end to its start; the places beyond its end stay."""
    places = np.arange(len(ids))[:, None]
    return np.where(places < lengths, lengths - 1 - places, places)


def _shared_states(gru: Gru, out: np.ndarray, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states times ``out``, which of them comes after each byte of each word); words share those of one beginning.

    No word is empty or longer than ``SPAN``.
    """
    width = max(8, int(lengths.max()))
    inside = np.arange(width) < lengths[:, None]
    ids = np.zeros(inside.shape, np.uint8)
    ids[inside] = np.frombuffer(b"".join(words), np.uint8)
    # Words with the same first eight bytes come together; a later difference may part words that share more.
    order = np.argsort(np.ascontiguousarray(ids[:, :8]).view(">u8").ravel().astype(np.uint64), kind="stable")
    by_place, reached = np.ascontiguousarray(ids[order].T), np.ascontiguousarray(inside[order].T)
    layer, weights = ColumnGru(gru.inputs, gru.states), np.ascontiguousarray(gru.states.T)
    found, places, held = [], np.empty(by_place.shape, np.intp), 0
    state, owners = np.zeros((gru.size, 1), np.float32), np.zeros(len(words), np.intp)
    shared = np.ones(len(words) - 1, bool)  # with the word before, up to this place
    for t in range(int(lengths.max())):
        shared &= (by_place[t, 1:] == by_place[t, :-1]) & reached[t, :-1]
        new = reached[t].copy()
        new[1:] &= ~shared
        first = np.flatnonzero(new)
        parents, bytes_at, after = owners[first], by_place[t, first], np.empty((gru.size, len(first)), np.float32)
        for some in (slice(i, i + ROWS_AT_ONCE) for i in range(0, len(first), ROWS_AT_ONCE)):
            gates = np.ascontiguousarray(gru.inputs[bytes_at[some]].T)
            after[:, some] = layer.step_columns(gates, state[:, parents[some]], weights)
        owners = np.cumsum(new) - 1
        np.add(owners, held, out=places[t])
        found.append(after.T @ out)
        state, held = after, held + len(first)
    in_order = np.empty((len(words), width), np.intp)
    in_order[order] = places.T
    return np.concatenate(found), in_order[inside]


class ByteNetwork:
    """Two recurrent layers, one from each end of a word, and a softmax over languages at each byte."""

    def __init__(self, languages: list[str], forward: Gru, backward: Gru, out: np.ndarray, bias: np.ndarray):
        self.languages, self.forward, self.backward, self.out, self.bias = languages, forward, backward, out, bias

    @classmethod
    def random(cls, languages: list[str], rng: np.random.Generator) -> ByteNetwork:
        n = len(languages)
        out = rng.normal(0, 0.1, (2 * HIDDEN, n)).astype(np.float32)
        return cls(languages, Gru.random(256, HIDDEN, rng), Gru.random(256, HIDDEN, rng), out, np.zeros(n, np.float32))

    def _states(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list, list, np.ndarray]:
        empty = np.zeros((ids.shape[1], HIDDEN), np.float32)
        turn = _turned(ids, lengths)
        ahead, kept_f = self.forward.run(ids, empty)
        behind, kept_b = self.backward.run(np.take_along_axis(ids, turn, 0), empty)
        both = np.concatenate([ahead, np.take_along_axis(behind, turn[:, :, None], 0)], 2)
        return both, kept_f, kept_b, turn

    def _probabilities(self, both: np.ndarray) -> np.ndarray:
        raw = both @ self.out + self.bias
        raw -= raw.max(2, keepdims=True)
        np.exp(raw, out=raw)
        return raw / raw.sum(2, keepdims=True)

    def at_bytes(self, words: list[bytes]) -> list[np.ndarray]:
        """For each word, the probabilities of the languages at each of its bytes."""
        ids, lengths = _padded(words)
        found = self._probabilities(self._states(ids, lengths)[0])
        return [found[:n, i] for i, n in enumerate(lengths)]

    def sums(self, words: list[bytes]) -> np.ndarray:
        """For each word, the sums of ``at_bytes`` over its bytes.

        A beginning that several words share, or an end, is gone through once for all of them.
        """
        out = np.zeros((len(words), len(self.languages)))
        limit = BYTES_AT_ONCE * HIDDEN // max(HIDDEN, len(self.languages))
        for start, end in slices(words, limit):
            part = words[start:end]
            lengths = np.array([len(w) for w in part])
            begins = np.cumsum(lengths) - lengths
            ahead, at_ahead = _shared_states(self.forward, self.out[:HIDDEN], part, lengths)
            behind, at_behind = _shared_states(self.backward, self.out[HIDDEN:], [w[::-1] for w in part], lengths)
            # From a place counted from a word's end to the same one counted from its start.
            at_behind = at_behind[np.repeat(2 * begins + lengths - 1, lengths) - np.arange(len(at_behind))]
            found = np.empty((len(self.languages), len(at_ahead)), np.float32)
            for some in (slice(i, i + ROWS_AT_ONCE) for i in range(0, len(at_ahead), ROWS_AT_ONCE)):
                raw = ahead[at_ahead[some]]
                raw += behind[at_behind[some]]
                raw = np.ascontiguousarray(raw.T)
                raw += self.bias[:, None]
                raw -= raw.max(0)
                np.exp(raw, out=raw)
                np.divide(raw, raw.sum(0), out=found[:, some])
            out[start:end] = np.add.reduceat(found, begins, 1).T
        return out

    def train(self, words: list[bytes], labels: np.ndarray, rng: np.random.Generator, steps: int = STEPS) -> None:
        """Backpropagation through time, of the cross-entropy at every byte.

        Every step draws as many words of one language as of another.
        """
        arrays = {
            "f_in": self.forward.inputs, "f_st": self.forward.states,
            "b_in": self.backward.inputs, "b_st": self.backward.states, "out": self.out, "bias": self.bias,
        }
        adam = Adam(arrays, 0.01)
        of = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        for step in range(steps):
            adam.rate = 0.01 * (1 - step / steps) + 0.0005
            target = rng.integers(0, len(of), ROWS)
            picked = [int(of[k][rng.integers(0, len(of[k]))]) for k in target]
            ids, lengths = _padded([words[i] for i in picked])
            both, kept_f, kept_b, turn = self._states(ids, lengths)
            d_raw = self._probabilities(both)
            d_raw[:, np.arange(ROWS), target] -= 1
            inside = np.arange(len(ids))[:, None] < lengths
            d_raw *= inside[:, :, None] / np.float32(lengths.sum())
            d_both = d_raw @ self.out.T
            d_behind = np.take_along_axis(d_both[:, :, HIDDEN:], turn[:, :, None], 0)
            f_in, f_st = self.forward.gradients(ids, kept_f, d_both[:, :, :HIDDEN])
            b_in, b_st = self.backward.gradients(np.take_along_axis(ids, turn, 0), kept_b, d_behind)
            d_out = both.reshape(-1, 2 * HIDDEN).T @ d_raw.reshape(-1, len(self.languages))
            adam.step({"f_in": f_in, "f_st": f_st, "b_in": b_in, "b_st": b_st, "out": d_out, "bias": d_raw.sum((0, 1))})


def _spans(word: str) -> list[bytes]:
    data = word.encode()
    if len(data) <= SPAN:
        return [data]
    return [data[i : i + SPAN] for i in range(0, len(data), SPAN)]


class Labeller:
    """Pooled probabilities of whole texts. What the network says of a word is remembered."""

    def __init__(self, network: ByteNetwork):
        self.network = network
        self._places: dict[str, int] = {}
        self._sums = np.zeros((CACHE_WORDS, len(network.languages)), np.float32)
        self._sizes = np.zeros(CACHE_WORDS, np.int32)
        self._times = np.zeros(CACHE_WORDS, np.int64)  # how often a word was met, halved when others are forgotten

    def _learn(self, words: set[str]) -> None:
        first, new = len(self._places), sorted(words)
        spans, owners = [], []
        for i, word in enumerate(new, first):
            if word[0].isalpha() or any(map(str.isalpha, word)):  # others say nothing
                parts = _spans(word)
                spans += parts
                owners += [i] * len(parts)
        own = slice(first, first + len(new))
        self._sums[own], self._sizes[own], self._times[own] = 0, 0, 0
        if spans:
            # The spans of a word are a run.
            begins = np.flatnonzero(np.diff(owners, prepend=-1))
            places = np.array(owners)[begins]
            self._sums[places] = np.add.reduceat(self.network.sums(spans), begins)
            self._sizes[places] = np.add.reduceat([len(s) for s in spans], begins)
        self._places.update(zip(new, range(first, first + len(new)), strict=True))

    def _forget(self) -> None:
        """Keep the words that were met most, and more than once, in at most half of the memory."""
        held = len(self._places)
        most = np.argsort(-self._times[:held], kind="stable")[: CACHE_WORDS - GROUP_WORDS]
        kept = np.sort(most[self._times[most] > 1])
        names = list(self._places)  # in the order of their places
        for values in (self._sums, self._sizes, self._times):
            values[: len(kept)] = values[kept]
        self._times[: len(kept)] //= 2
        self._places = {names[i]: at for at, i in enumerate(kept.tolist())}

    def _known(self, words: list[str]) -> np.ndarray:
        """The places of the words, at most ``GROUP_WORDS``, in the memory."""
        places = np.fromiter(map(self._places.get, words, repeat(-1)), np.intp, len(words))
        missing = np.flatnonzero(places < 0)
        if len(missing):
            names = [words[i] for i in missing.tolist()]
            unseen = set(names)
            if len(self._places) + len(unseen) > CACHE_WORDS:
                self._forget()
                return self._known(words)
            self._learn(unseen)
            places[missing] = np.fromiter(map(self._places.__getitem__, names), np.intp, len(names))
        self._times += np.bincount(places, minlength=CACHE_WORDS)
        return places

    def pooled(self, texts: list[str]) -> np.ndarray:
        """The mean of the probabilities over all bytes of words with a letter; zeros without any.

        Words of several texts are looked up together, and those of a long text in turns.
        """
        sums, sizes = np.zeros((len(texts), len(self.network.languages))), np.zeros(len(texts))
        words: list[str] = []
        pieces: list[tuple[int, int]] = []  # (text, words of it)

        def look_up() -> None:
            places, at = self._known(words), 0
            for text, n in pieces:
                own = places[at : at + n]
                sums[text] += self._sums[own].sum(0, dtype=np.float64)
                sizes[text] += self._sizes[own].sum(dtype=np.int64)
                at += n
            words.clear()
            pieces.clear()

        for i, text in enumerate(texts):
            own = text.lower().split()
            for at in range(0, len(own), GROUP_WORDS):
                part = own[at : at + GROUP_WORDS]
                if len(words) + len(part) > GROUP_WORDS:
                    look_up()
                words += part
                pieces.append((i, len(part)))
        look_up()
        return np.divide(sums, sizes[:, None], out=np.zeros_like(sums), where=sizes[:, None] > 0)

    def label(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.network.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        pooled = self.pooled(texts)
        best = pooled.argmax(1)
        scores = [float(min(1.0, row[i])) for row, i in zip(pooled, best, strict=True)]
        return [self.network.languages[i] if s else UNDETERMINED for i, s in zip(best, scores, strict=True)], scores


_labellers: dict[bytes, Labeller] = {}  # of this worker


def _labeller(network: ByteNetwork | None) -> Labeller:
    """What a worker remembers of words outlives a task."""
    if network is None:
        return Labeller(ByteNetwork.random([], np.random.default_rng(SEED)))
    key = network.out.tobytes()
    if key not in _labellers:
        _labellers.clear()
        _labellers[key] = Labeller(network)
    return _labellers[key]


def _pieces(text: Column) -> Column:
    """The text, or ``PIECES`` of a long one, of ``DOC_BYTES`` characters in all, from its start to its end."""
    size = DOC_BYTES // PIECES
    gap = (F.char_length(text).cast("long") - size) / (PIECES - 1)
    starts = F.sequence(F.lit(0), F.lit(PIECES - 1))
    spread = F.transform(starts, lambda i: F.substr(text, F.greatest(F.lit(1), F.floor(i * gap) + 1).cast("int"), F.lit(size)))
    return F.when(F.octet_length(text) <= DOC_BYTES, F.array(text)).otherwise(spread)


def _words(pieces: list[str]) -> list[str]:
    """The words of a text; of pieces, without those at their edges, if there are others."""
    found = [piece.lower().split() for piece in pieces]
    if len(pieces) > 1:
        found = [words[1:-1] if len(words) > 2 else words for words in found]
    return [word for words in found for word in words]


def fit(docs: DataFrame) -> ByteNetwork | None:
    """A network from documents (doc_id, text, lang) of the folds that may be learnt from; None without any.

    Only the text and the language are learnt from. The fit takes at most
    ``DOCS_PER_LANGUAGE`` ids of a language and ``DOCS`` in all, the first by a hash of the
    id, with one row each, and about ``DOC_BYTES`` bytes of a document. Longer documents are
    taken where a language has too few others.
    """
    learnt = (fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull()
    usable = docs.where(learnt & (F.octet_length("text") >= 1))
    distinct = usable.groupBy("doc_id", "lang").agg((F.min(F.octet_length("text")) > DOC_BYTES).alias("long"))
    first = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id", F.lit(1)), "doc_id")
    # Rank filters are applied within the map tasks before rows of a language meet.
    ids = (
        distinct.select("doc_id", "lang", F.row_number().over(first).alias("rank"))
        .where(F.col("rank") <= DOCS_PER_LANGUAGE)
        .orderBy("rank", "lang")
        .limit(DOCS)
        .select("doc_id", "lang")
    )
    # Repeated rows of an id meet as one in the map tasks.
    taken = usable.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", _pieces(F.col("text")).alias("pieces"))
    rows = taken.groupBy("doc_id", "lang").agg(F.min(F.struct(F.size("pieces"), "pieces")).alias("first")).collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    words, labels = [], []
    for row in sorted(rows, key=lambda r: (r["doc_id"], r["lang"])):
        for word in _words(row["first"]["pieces"]):
            if any(map(str.isalpha, word)):
                parts = _spans(word)
                words += parts
                labels += [languages.index(row["lang"])] * len(parts)
    present = sorted(set(labels))
    if not present:
        return None
    rng = np.random.default_rng(SEED)
    network = ByteNetwork.random([languages[k] for k in present], rng)
    network.train(words, np.searchsorted(present, labels), rng)
    return network


def label_languages(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``df``.

    The network labels every byte of every word, with the word as its context, and a
    document's score is the mean probability over the bytes of its words that have a
    letter; so what a word gives is worked out once and reused. ``lang_pred`` is ``und``
    with score 0 for a null text, one without a letter, or where nothing could be learnt.
    Repeated rows are labelled alike. Rows without an id are labelled, but not learnt from.
    """
    docs = df.select(column(doc).cast("long").alias("doc_id"), column(text).alias("text"), column(lang).alias("lang"))
    network = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(network)
        for batch in small_batches(batches):
            found, scores = labeller.label([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return texts_in_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def keep_clear(
    df: DataFrame, least: float = CLEAR_SCORE, doc: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The rows of ``df`` in a language that ``label_languages`` knows, with a score of at least ``least``.

    Rows stay as they are and are not moved. Where no language can be learnt, none is clear or
    unclear: the rows whose text has a letter stay.
    """
    docs = df.select(column(doc).cast("long").alias("doc_id"), column(text).alias("text"), column(lang).alias("lang"))
    network = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = _labeller(network)
        for batch in small_batches(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            if network is None:
                kept = [any(map(str.isalpha, t)) for t in texts]
            else:
                kept = [s > 0 and s >= least for s in labeller.label(texts)[1]]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return texts_in_arrow(df, run, df.schema)
