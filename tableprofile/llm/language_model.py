"""Log-probabilities of whole texts from a gated recurrent language model over words."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import column
from .common import in_arrow, slices, stored
from .gru import Adam, ColumnGru
from .samples import fold

FOLDS = 10
SMOOTHING = 0.1  # fixed by the contract of the base score
END = b""  # counted as a token; no word is empty

# Sizes of the model. Words beyond the first FREQUENT belong to a tail class by their last
# two characters; within it a word has its share of the counts.
FREQUENT = 2000
WORD_CLASSES = 40
TAIL_CLASSES = 48
HIDDEN = 16
# Words whose counts every task holds; the counts of the others are joined.
SHARED_WORDS = 1 << 17
WINDOW = 24  # steps of truncated backpropagation
SCORE_WINDOW = 96  # steps of scoring at once
STREAMS = 384  # documents side by side in training
SCORE_STREAMS = 256  # and in scoring
BATCH_TOKENS = 1_500_000  # scored together, or one longer document
TEXT_BYTES = 1 << 22  # of texts taken apart together
# The first fit, on one machine, takes the beginnings of at most FIRST_DOCS documents.
FIRST_DOCS = 600
FIRST_DOC_BYTES = 16_384
FLUSH_WORDS = 1 << 20  # counted by a task before they are added up
WORDS_PER_BATCH = 1 << 16
ROWS_AT_ONCE = 1024  # of a softmax over classes, so that they stay near the processor
SEED = 11
RATE = 0.005
ADDED_AT_ONCE = 64  # rows of parameters that a task adds up


def tokens_of(text: bytes) -> list[bytes]:
    """Words and one end. A-Z are lower-cased, and ASCII white space separates words."""
    return [*text.lower().split(), END]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def split_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, how many of them up to the end of each): those of ``tokens_of`` without the ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).cast(pa.string())))
    flat = lists.flatten()
    # White space at an end of a text leaves an empty word.
    full = pc.not_equal(flat, "")
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), upto[lists.offsets.to_numpy()[1:]]


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word binary, c): how often each token occurs, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> pa.Table:
            sums = pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("c", "sum")])
            return sums.select(["word", "c_sum"]).rename_columns(["word", "c"])

        def flush() -> Iterator[pa.RecordBatch]:
            total = merged()
            total = total.set_column(0, "word", total["word"].cast(pa.binary()))
            return total.to_batches(max_chunksize=WORDS_PER_BATCH)

        found: list[pa.Table] = []  # a table without a word twice, and those of texts since
        held = n_docs = 0
        for batch in batches:
            texts = _texts(batch)
            n_docs += len(texts)
            for a, b in slices(texts, TEXT_BYTES):
                counted = pc.value_counts(split_words(texts[a:b])[0])
                found.append(pa.table({"word": counted.field(0), "c": counted.field(1)}))
                held += len(counted)
                if held > FLUSH_WORDS:
                    found = [merged()]
                    held = len(found[0])
                    # Few words met again: what is held goes on.
                    if 2 * held > FLUSH_WORDS:
                        yield from flush()
                        found, held = [], 0
        if n_docs:
            found.append(pa.table({"word": pa.array([END.decode()]), "c": pa.array([n_docs], pa.int64())}))
            yield from flush()

    return in_arrow(docs.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _suffix(word: bytes) -> str:
    return word.decode()[-2:]


@dataclass
class Words:
    """What every task knows of the counted words."""

    n: int  # tokens
    v: int  # distinct ones
    places: dict[bytes, int]  # of the shared words, by falling count
    log_counts: np.ndarray  # log10(c + SMOOTHING) of the shared words
    tails: dict[str, int]  # tail class of a suffix; the last class has all others
    tail_logs: np.ndarray  # log10 of the smoothed size of each tail class
    frequent: int  # the first so many shared words have a place in the model

    def model_ids(self) -> np.ndarray:
        """The model's number of each shared word: its place, or that of its tail class behind them."""
        ids = np.arange(len(self.places))
        names = [word.decode() for word in self.places]
        at = np.fromiter(self.places.values(), np.int64, len(names))
        in_tail = at >= self.frequent
        ids[at[in_tail]] = self.tail_numbers(pa.array(names, pa.string()).filter(pa.array(in_tail)))
        return ids

    def tail_numbers(self, words: pa.Array) -> np.ndarray:
        """The model's numbers of the tail classes of words."""
        known = pa.array(sorted(self.tails, key=self.tails.get), pa.string())
        found = pc.index_in(pc.utf8_slice_codeunits(words, -2), value_set=known)
        return self.frequent + found.fill_null(len(self.tail_logs) - 1).to_numpy()


def know_words(counts: DataFrame) -> Words:
    """Gather from the stored ``counts`` what is bounded: the shared words and the tail classes."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # The smallest power of two that at most SHARED_WORDS words reach as their count.
    sizes = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).count().orderBy(F.desc("k")).collect()
    least, held = None, 0
    for row in sizes:  # at most 63
        held += row["count"]
        if held > SHARED_WORDS:
            break
        least = 1 << row["k"]
    shared = counts.where(F.col("c") >= (least or 1 << 62)).collect()
    ordered = sorted(((bytes(r["word"]), r["c"]) for r in shared), key=lambda x: (-x[1], x[0]))
    if END not in {w for w, _ in ordered[:FREQUENT]}:  # the end always has a place in the model
        ends = [x for x in ordered if x[0] == END]
        ordered = [*ends, *(x for x in ordered if x[0] != END)]
    frequent = min(FREQUENT, len(ordered))
    suffix = F.substring(F.col("word").cast("string"), -2, 2)
    per_suffix = counts.groupBy(suffix.alias("s")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    top = {r["s"]: [r["c"], r["v"]] for r in per_suffix.orderBy(F.desc("c"), "s").limit(4 * TAIL_CLASSES).collect()}
    others = [total["n"], total["v"]]
    for word, c in ordered[:frequent]:  # they are no tail words
        others = [others[0] - c, others[1] - 1]
        if _suffix(word) in top:
            top[_suffix(word)] = [top[_suffix(word)][0] - c, top[_suffix(word)][1] - 1]
    chosen = sorted((s for s in top if top[s][0] > 0), key=lambda s: (-top[s][0], s))[: TAIL_CLASSES - 1]
    sizes = [top[s] for s in chosen]
    sizes.append([others[0] - sum(c for c, _ in sizes), others[1] - sum(v for _, v in sizes)])
    return Words(
        total["n"],
        total["v"],
        {w: i for i, (w, _) in enumerate(ordered)},
        np.log10(np.array([c for _, c in ordered], float) + SMOOTHING),
        {s: i for i, s in enumerate(chosen)},
        np.log10([c + SMOOTHING * (v + 1) for c, v in sizes]),
        frequent,
    )


_ONES = {t: np.ones(FREQUENT + WORD_CLASSES + TAIL_CLASSES, t) for t in "fd"}


def _flat(raw: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Where the elements at a column of each row are in ``raw.ravel()``."""
    at = np.arange(0, raw.size, raw.shape[1])
    at += columns
    return at


class WordModel:
    """The class of the next token by a softmax over the state, and a frequent word within its class by another.

    Classes of frequent words hold equal shares of the counts; tail classes follow them.
    """

    def __init__(self, frequent: int, n_tails: int, starts: np.ndarray, arrays: dict[str, np.ndarray]):
        self.frequent, self.n_tails, self.starts, self.arrays = frequent, n_tails, starts, arrays
        self.gru = ColumnGru(arrays["in"], arrays["st"])
        self.first_tail = len(starts) - 1
        of_words = np.searchsorted(starts, np.arange(frequent), "right") - 1
        classes = np.concatenate([of_words, self.first_tail + np.arange(n_tails)])
        # Small numbers are sorted in one or two passes.
        self.class_of = classes.astype(np.min_scalar_type(self.first_tail + n_tails))

    @classmethod
    def random(cls, words: Words, seed: int = SEED) -> WordModel:
        rng = np.random.default_rng(seed)
        counts = 10 ** words.log_counts[: words.frequent]
        share = np.cumsum(counts) / max(1.0, counts.sum())
        starts = np.unique(np.concatenate([[0], np.searchsorted(share, np.arange(1, WORD_CLASSES) / WORD_CLASSES), [words.frequent]]))
        n_tails = len(words.tail_logs)
        n_classes = len(starts) - 1 + n_tails
        gru = ColumnGru.random(words.frequent + n_tails, HIDDEN, rng)
        masses = [counts[a:b].sum() for a, b in zip(starts, starts[1:], strict=False)]
        total = np.concatenate([masses, 10**words.tail_logs])
        arrays = {
            "in": gru.inputs,
            "st": gru.states,
            "class": rng.normal(0, 0.05, (HIDDEN, n_classes)).astype(np.float32),
            "class_bias": np.log(total / total.sum() + 1e-9).astype(np.float32),
            "word": rng.normal(0, 0.05, (words.frequent, HIDDEN)).astype(np.float32),
            "word_bias": np.log(counts + 1e-9).astype(np.float32),
        }
        return cls(words.frequent, n_tails, starts, arrays)

    def _softmax(self, raw: np.ndarray, targets: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
        """(logarithm of the softmax at the targets, sums); ``raw`` becomes its exponentials."""
        if not safe:
            raw -= raw.max(1, keepdims=True)
        picked = raw.ravel()[_flat(raw, targets)].astype(np.float64)
        np.exp(raw, out=raw)
        total = raw @ _ONES[raw.dtype.char][: raw.shape[1]]
        return picked - np.log(total, dtype=np.float64), total

    @staticmethod
    def _errors(raw: np.ndarray, targets: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Exponentials become the gradient of -ln P times their sum; returned is what to multiply them with."""
        raw.ravel()[_flat(raw, targets)] -= total
        return (1 / total).astype(raw.dtype)[:, None]

    def _is_safe(self) -> bool:
        """Whether no exponential can leave the range of its type: a state's numbers are between -1 and 1."""
        w = self.arrays
        largest = max(
            float((np.abs(w["class"]).sum(0) + np.abs(w["class_bias"])).max()),
            float((np.abs(w["word"]).sum(1) + np.abs(w["word_bias"])).max(initial=0)),
        )
        return largest < 60

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray, gradients: dict | None = None) -> tuple:
        """ln P of each target after its state; with ``gradients``, also those of -ln P summed, and of the states."""
        w, safe = self.arrays, self._is_safe() and len(states) and float(np.abs(states).max()) <= 1
        # Sorted by class, so that the tokens of a class are one run.
        order = np.argsort(self.class_of[targets], kind="stable")
        targets = targets[order]
        classes = self.class_of[targets]
        # The last column of a state is 1: that of a weight is the bias.
        extended = np.ones((len(order), HIDDEN + 1), states.dtype)
        np.take(states, order, 0, out=extended[:, :HIDDEN])
        of_classes = np.concatenate([w["class"], w["class_bias"][None]])
        of_words = np.concatenate([w["word"], w["word_bias"][:, None]], 1)
        d_states = None
        if gradients is not None:
            d_states, d_classes, d_words = np.empty_like(states), np.zeros_like(of_classes), np.zeros_like(of_words)
        out = np.empty(len(order))
        for a in range(0, len(order), ROWS_AT_ONCE):
            some = slice(a, a + ROWS_AT_ONCE)
            h, at = extended[some], classes[some]
            raw = h @ of_classes
            out[some], total = self._softmax(raw, at, safe)
            if gradients is not None:
                share = self._errors(raw, at, total)
                d_classes += (h * share).T @ raw
                np.multiply(raw @ w["class"].T, share, out=d_states[some])
        bounds = np.searchsorted(classes, np.arange(self.first_tail + 1))
        for k in range(self.first_tail):
            own, a, b = slice(bounds[k], bounds[k + 1]), self.starts[k], self.starts[k + 1]
            if bounds[k] == bounds[k + 1] or b - a == 1:
                continue
            h, at = extended[own], targets[own] - a
            raw = h @ of_words[a:b].T
            logs, total = self._softmax(raw, at, safe)
            out[own] += logs
            if gradients is not None:
                share = self._errors(raw, at, total)
                d_words[a:b] = raw.T @ (h * share)
                d_states[own] += (raw @ w["word"][a:b]) * share
        if gradients is not None:
            gradients["class"] += d_classes[:-1]
            gradients["class_bias"] += d_classes[-1]
            gradients["word"] += d_words[:, :-1]
            gradients["word_bias"] += d_words[:, -1]
        logs = np.empty_like(out)
        logs[order] = out
        if d_states is not None:
            found = np.empty_like(d_states)
            found[order] = d_states
            d_states = found
        return logs, d_states

    def train(self, documents: Iterator[np.ndarray], rate: float, streams: int = STREAMS) -> int:
        """One pass of truncated backpropagation over documents of token numbers; returns the tokens seen.

        Documents run side by side in streams, one after the other; a state is carried from
        window to window and emptied where a document begins. When no document is left, the
        streams that still hold tokens go on alone, the fewer they are the more steps at once,
        until all are empty: every token is learnt from.
        """
        adam = Adam(self.arrays, rate)
        held: list[list[np.ndarray]] = [[] for _ in range(streams)]
        sizes = np.zeros(streams, int)
        h, seen, full = np.zeros((streams, HIDDEN), np.float32), 0, WINDOW * streams
        starts_next = np.ones(streams, np.float32)

        def window(steps: int) -> None:
            nonlocal h, seen
            ids, begins = np.zeros((steps, len(held)), np.intp), np.zeros((steps, len(held)), np.float32)
            lengths = np.minimum(sizes, steps)
            for s, length in enumerate(lengths.tolist()):
                at, begins[0, s] = 0, starts_next[s]
                while at < length:
                    part = held[s][0][: length - at]
                    ids[at : at + len(part), s] = part
                    at += len(part)
                    left = held[s][0][len(part) :]
                    starts_next[s] = float(not len(left))
                    if len(left):
                        held[s][0] = left
                    else:
                        held[s].pop(0)
                        if at < length:
                            begins[at, s] = 1
            h = self._train_window(adam, ids, 1 - begins, h, lengths, full)
            sizes[:] -= lengths
            seen += int(lengths.sum())

        for document in documents:
            into = int(sizes.argmin())
            held[into].append(document)
            sizes[into] += len(document)
            while sizes.min() >= WINDOW:
                window(WINDOW)
        while sizes.any():
            rest = np.flatnonzero(sizes)
            held = [held[s] for s in rest]
            sizes, h, starts_next = sizes[rest], h[rest], starts_next[rest]
            window(min(int(sizes.max()), full // len(rest)))
        return seen

    def _train_window(
        self, adam: Adam, ids: np.ndarray, keep: np.ndarray, h: np.ndarray, lengths: np.ndarray, full: int
    ) -> np.ndarray:
        """A step of all streams; of a stream, the first so many of ``ids`` are tokens.

        Each token weighs as much as one of a window of ``full`` tokens.
        """
        steps, streams = ids.shape
        after, kept = self.gru.run(ids, h, keep)
        # The state before a token tells it; where a document begins it is empty.
        before = np.ascontiguousarray(kept[0].transpose(0, 2, 1))
        gradients = {k: np.zeros_like(v) for k, v in self.arrays.items()}
        if lengths.min() == steps:
            _, d_before = self.log_probabilities(before.reshape(-1, HIDDEN), ids.ravel(), gradients)
            d_before = d_before.reshape(steps, streams, HIDDEN)
        else:  # nothing comes back from behind the end of a stream
            inside = np.arange(steps)[:, None] < lengths
            d_before = np.zeros_like(before)
            d_before[inside] = self.log_probabilities(before[inside], ids[inside], gradients)[1]
        d_after = np.zeros_like(kept[0])
        np.multiply(d_before[1:].transpose(0, 2, 1), keep[1:, None], out=d_after[:-1])
        gradients["in"], gradients["st"] = self.gru.gradients(ids, kept, d_after.transpose(0, 2, 1), keep)
        for g in gradients.values():
            g /= full
        adam.step(gradients)
        return after[-1]

    def score(self, documents: list[np.ndarray], streams: int = SCORE_STREAMS) -> np.ndarray:
        """ln P of each whole document of token numbers.

        Documents run side by side in streams of about one length, one after the other; the
        state is carried through all windows of a document, however many there are.
        """
        loads = [(0, s) for s in range(min(streams, len(documents)))]
        dealt: list[list[int]] = [[] for _ in loads]
        for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
            load, s = loads[0]
            dealt[s].append(i)
            heapq.heapreplace(loads, (load + len(documents[i]), s))
        dealt.sort(key=lambda own: -sum(len(documents[i]) for i in own))
        lengths = np.array([sum(len(documents[i]) for i in own) for own in dealt])
        in_order = [i for own in dealt for i in own]
        flat = np.concatenate([documents[i] for i in in_order])
        sizes = np.array([len(documents[i]) for i in in_order])
        owner = np.repeat(in_order, sizes)
        opens = np.zeros(len(flat), bool)
        opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        begins = np.cumsum(lengths) - lengths
        out, h = np.zeros(len(documents)), np.zeros((len(dealt), HIDDEN), np.float32)
        for start in range(0, int(lengths[0]), SCORE_WINDOW):
            active = int(np.searchsorted(-lengths, -start, "left"))  # streams that go on
            steps = start + np.arange(min(SCORE_WINDOW, int(lengths[0]) - start))[:, None]
            inside = steps < lengths[:active]
            at = np.where(inside, begins[:active] + steps, begins[:active] + start)
            keep = 1 - opens[at].astype(np.float32)
            ids = flat[at]
            before, h = self.gru.before(ids, h[:active], keep)
            whole = int(lengths[active - 1]) >= start + len(steps)  # no stream ends here
            at, ids, before = (x.reshape(-1, *x.shape[2:]) if whole else x[inside] for x in (at, ids, before))
            logs, _ = self.log_probabilities(before, ids)
            out += np.bincount(owner[at], logs, len(documents))
        return out


class _Numbers:
    """Tokens as numbers of the model, and what is known of them."""

    def __init__(self, words: Words):
        self.words, self.ids = words, np.append(words.model_ids(), 0)  # the last is for words without a place
        self._placed = pa.array([w.decode() for w in sorted(words.places, key=words.places.get)], pa.string())

    def of_slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, pa.Array]]:
        """(model numbers of all tokens, their places or -1, tokens up to the end of each text, those without a place).

        The last are the numbers of their texts, and the words.
        """
        words, upto = split_words(texts)
        words = pa.concat_arrays([words, pa.array([END.decode()], pa.string())])
        found = pc.index_in(words, value_set=self._placed).fill_null(-1).to_numpy()
        numbers, unknown = self.ids[found], found < 0
        if unknown.any():
            numbers[unknown] = self.words.tail_numbers(words.filter(pa.array(unknown)))
        # The end, last of the words, comes after those of each text.
        upto = upto + np.arange(1, len(texts) + 1)
        tokens = np.full(len(words) - 1 + len(texts), len(words) - 1)
        is_word = np.ones(len(tokens), bool)
        is_word[upto - 1] = False
        tokens[is_word] = np.arange(len(words) - 1)
        places = found[tokens]
        others = np.flatnonzero(places < 0)
        return numbers[tokens], places, upto, (np.searchsorted(upto, others, "right"), words.take(pa.array(tokens[others])))

    def of_texts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The model numbers of each text."""
        for a, b in slices(texts, TEXT_BYTES):
            numbers, _, upto, _ = self.of_slice(texts[a:b])
            yield from np.split(numbers, upto[:-1])


def _first_tokens(beginning: bytes) -> list[bytes]:
    """The tokens of a text of at most ``FIRST_DOC_BYTES``, or the whole words at the beginning of a longer one."""
    if len(beginning) <= FIRST_DOC_BYTES:
        return tokens_of(beginning)
    words = beginning.lower().split()
    return words if beginning[-1:].isspace() else words[:-1]


def _first_numbers(beginning: bytes, numbers: _Numbers) -> np.ndarray:
    tokens = _first_tokens(beginning)
    ids = next(numbers.of_texts([b" ".join(tokens)]))
    return ids if tokens and tokens[-1] == END else ids[:-1]


def fit(docs: DataFrame, words: Words) -> WordModel:
    """Train the recurrent model.

    A bounded first fit gives all tasks the same start. Then each task goes over all of its
    training documents, and the parameters are averaged, weighted by tokens seen.
    """
    model = WordModel.random(words)
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", F.lit(2))
    # One byte more tells a text that goes on.
    beginning = F.substring(F.col("text").cast("binary"), 1, FIRST_DOC_BYTES + 1)
    ids = docs.select("doc_id").distinct().orderBy(order, "doc_id").limit(FIRST_DOCS)
    # One row of an id; repeated ones meet in the map tasks.
    first = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(beginning).alias("text")).collect()
    numbers = _Numbers(words)
    texts = [_first_numbers(bytes(r["text"]), numbers) for r in sorted(first, key=lambda r: r["doc_id"])]
    for _ in range(2):
        model.train((t for t in texts if len(t)), 0.01, streams=48)
    start = spark.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, given = start.value
        own = WordModel(given.frequent, given.n_tails, given.starts, {k: v.copy() for k, v in given.arrays.items()})
        numbers = _Numbers(words)
        seen = own.train((ids for batch in batches for ids in numbers.of_texts(_texts(batch))), RATE)
        if seen:
            total = {k: v.astype(np.float64) * seen for k, v in own.arrays.items()}
            yield _row(TaskContext.get().partitionId(), seen, total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}  # a partition has few groups
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                arrays, total = pickle.loads(row["arrays"]), totals.setdefault(row["part"], [0, None])
                total[0] += row["seen"]
                total[1] = arrays if total[1] is None else {k: v + arrays[k] for k, v in total[1].items()}
        for part, (seen, arrays) in totals.items():
            yield _row(part, seen, arrays)

    sums = stored(in_arrow(docs.select("text"), run, _SUM_SCHEMA), "trained")
    # A few rows at a time become one, until one is left: how many tasks trained, and how Spark
    # deals their rows out, changes nothing for the driver.
    last = sums.agg(F.max("part")).first()[0]
    while last:
        grouped = sums.withColumn("part", F.floor(F.col("part") / ADDED_AT_ONCE).cast("int"))
        last //= ADDED_AT_ONCE
        sums = stored(in_arrow(grouped.repartition(last + 1, "part"), add, _SUM_SCHEMA), "added")
    found = sums.collect()  # one row
    if found:
        total = pickle.loads(found[0]["arrays"])
        mean = {k: (total[k] / found[0]["seen"]).astype(np.float32) for k in model.arrays}
        model = WordModel(model.frequent, model.n_tails, model.starts, mean)
    return model


_SUM_SCHEMA = "part int, seen long, arrays binary"


def _row(part: int, seen: int, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([pickle.dumps(arrays)], pa.binary())],
        ["part", "seen", "arrays"],
    )


_SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, word binary, n long"


def _score_rows(docs: DataFrame, words: Words, model: WordModel) -> DataFrame:
    """Rows without a word: a document, with what shared words give. Rows with one: how often it is in a document."""
    shared = docs.sparkSession.sparkContext.broadcast((words, model))
    types = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.binary(), pa.int64()]
    names = [part.split()[0] for part in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        numbers, row = _Numbers(words), TaskContext.get().partitionId() << 40
        all_log = np.log10(words.n + SMOOTHING * (words.v + 1))
        keys, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            logs = model.score(ids) / np.log(10)
            docs = [*zip(*keys, strict=True)]
            docs[5] = np.add(docs[5], logs)
            nulls = [None] * len(keys)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([*docs, nulls, nulls], types, strict=True)], names)

        def rare(rows: np.ndarray, others: pa.Array) -> pa.RecordBatch:
            coded = others.dictionary_encode()
            pairs = rows * len(coded.dictionary) + coded.indices.to_numpy()
            pairs, counts = np.unique(pairs, return_counts=True)
            rows, codes = np.divmod(pairs, max(1, len(coded.dictionary)))
            empty = [pa.nulls(len(pairs), t) for t in types[1:6]]
            found = coded.dictionary.take(pa.array(codes)).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(rows + row), *empty, found, pa.array(counts, pa.int64())], names)

        for batch in batches:
            texts, doc_ids = _texts(batch), batch.column("doc_id").to_pylist()
            for a, b in slices(texts, TEXT_BYTES):
                flat, places, upto, others = numbers.of_slice(texts[a:b])
                yield rare(*others)
                for key, own, known in zip(doc_ids[a:b], np.split(flat, upto[:-1]), np.split(places, upto[:-1]), strict=True):
                    known = known[known >= 0]
                    tails = own[own >= words.frequent] - words.frequent
                    in_tail = known[known >= words.frequent]
                    base = float(words.log_counts[known].sum() - len(own) * all_log)
                    tail = float(words.log_counts[in_tail].sum() - words.tail_logs[tails].sum())
                    keys.append((row, key, len(own), len(known), base, tail))
                    ids.append(own)
                    row += 1
                    size += len(own)
                    if size >= BATCH_TOKENS:
                        yield flush()
                        keys, ids, size = [], [], 0
        if keys:
            yield flush()

    return in_arrow(docs, run, _SCORED)


def score_texts(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``.

    Both scores are log10 of a probability of the whole text, the end included. The base is
    the smoothed unigram of the counts of all training documents. The model's is a recurrent
    network's: it gives the class of each token, and a frequent word within its class; a word
    of a tail class, unseen words among them, has its smoothed share of the counts there.

    A null text is an empty one: its only token is the end. Repeated rows are scored alike
    and counted each. Rows without an id are scored but not learnt from. With no document to
    learn from, the counts are empty and the scores follow from that. Other columns are not
    looked at.
    """
    docs = df.select(column(doc).cast("long").alias("doc_id"), column(text).alias("text"))
    training = docs.where(fold(F.col("doc_id"), FOLDS) != 0)
    counts = stored(count_tokens(training), "counts")
    words = know_words(counts)
    model = fit(training.where(F.col("text").isNotNull()), words)
    rows = stored(_score_rows(docs, words, model), "scores")
    rare = rows.where(F.col("word").isNotNull()).select("row", "word", "n")
    # A word with many rows is one that no training document has, or a common one beyond the
    # shared words; the join splits it.
    known = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
    )
    return (
        rows.where(F.col("word").isNull())
        .join(known, "row", "left")
        .select(
            "doc_id",
            F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(words.n).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("rare_log", F.lit(0.0))).alias("base_score"),
            (F.col("score") + F.coalesce("rare_log", F.lit(0.0))).alias("score"),
        )
    )
