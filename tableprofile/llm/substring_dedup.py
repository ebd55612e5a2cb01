"""Passages that repeat across documents: winnowed seeds, extended both ways."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import column
from .common import in_arrow, mix, range_hashes, slices, small_batches, stored, word_hashes

MIN_WORDS = 20


def seed_words(words: int) -> int:
    """Words of a seed: two fifths of the least repeat, which is extended by the other three."""
    return max(1, words * 2 // 5)


def _leasts(values: np.ndarray, size: int) -> np.ndarray:
    """Where the least of each ``size`` values in a row is; of equal ones the last."""
    places, held = np.arange(len(values)), 1
    while held < size:
        step = min(held, size - held)
        right = values[step:] <= values[:-step]
        values = np.where(right, values[step:], values[:-step])
        places = np.where(right, places[step:], places[:-step])
        held += step
    return places


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` words in a row."""
    salts = mix(np.arange(1, k + 1, dtype=np.uint64))
    grams = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        grams += mix(hashes[i : len(hashes) - k + 1 + i] + salts[i])
    return mix(grams)


def winnowed(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each seed, its place, hash of each word, where each text's words begin).

    Of the seeds in each run of ``words`` words the one with the least hash is chosen. So
    two equal runs, wherever they stand, have a seed in the same place.
    """
    k = seed_words(words)
    hashes, begins = word_hashes(texts, lower=False)
    if len(hashes) < words:
        return np.zeros(0, np.uint64), np.zeros(0, np.intp), hashes, begins
    grams = _grams(hashes, k)
    places = _leasts(grams, words - k + 1)
    ends = np.repeat(begins[1:], np.diff(begins))[: len(places)]
    places = places[np.arange(len(places)) + words <= ends]  # runs within one text
    places = places[np.diff(places, prepend=-1) > 0]
    return grams[places], places, hashes, begins


def contexts(places: np.ndarray, hashes: np.ndarray, begins: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """(context, words before, words behind, place in its text, text) of each seed.

    The context is a hash of the seed with all the words around it that a least repeat can
    reach within the text.
    """
    k = seed_words(words)
    reach = words - k
    text = np.searchsorted(begins, places, "right") - 1
    pos = places - begins[text]
    before = np.minimum(reach, pos)
    behind = np.minimum(reach, begins[text + 1] - places - k)
    around = range_hashes(hashes, places - before, places + k + behind)
    return mix(around + mix((before * (reach + 1) + behind).astype(np.uint64))), before, behind, pos, text


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _seed_counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = _texts(batch)
            found = [winnowed(texts[a:b], words)[0] for a, b in slices(texts)]
            seeds, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(counts.astype(np.int64))], ["seed", "n"])

    return run


_PLACES = "seed long, context long, before int, behind int, doc_id long, tag long, pos int"


def _seed_places(words: int):
    names = [part.split()[0] for part in _PLACES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = _texts(batch)
            for a, b in slices(texts):
                seeds, places, hashes, begins = winnowed(texts[a:b], words)
                context, before, behind, pos, text = contexts(places, hashes, begins, words)
                rows = pa.array(a + text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seeds.view(np.int64)),
                        pa.array(context.view(np.int64)),
                        *(pa.array(c.astype(np.int32)) for c in (before, behind)),
                        *(batch.column(c).take(rows) for c in ("doc_id", "tag")),
                        pa.array(pos.astype(np.int32)),
                    ],
                    names,
                )

    return run


_RUNS = "seed long, key long, doc_id long, tag long, start int"


def _runs_of_seeds(words: int):
    """For each wanted seed of a text, every run of ``words`` words around it."""
    k = seed_words(words)
    names = [part.split()[0] for part in _RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, wanted = _texts(batch), batch.column("wanted").to_pylist()
            for a, b in slices(texts):
                hashes, begins = word_hashes(texts[a:b], lower=False)
                grams = _grams(hashes, k)
                rows = np.repeat(np.arange(b - a), [len(w) for w in wanted[a:b]])
                places = begins[rows] + np.concatenate([np.array(w, np.intp) for w in wanted[a:b]])
                first = np.maximum(begins[rows], places - (words - k))
                counts = np.minimum(places, begins[rows + 1] - words) - first + 1
                seeds, rows = np.repeat(grams[places], counts), np.repeat(rows, counts)
                starts = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                keys = range_hashes(hashes, starts, starts + words)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c.view(np.int64)) for c in (seeds, keys)),
                        *(batch.column(c).take(pa.array(a + rows)) for c in ("doc_id", "tag")),
                        pa.array((starts - begins[rows]).astype(np.int32)),
                    ],
                    names,
                )

    return run


def _with_texts(docs: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """``docs`` with the lists of ``per_doc``, which has a row for a document and its tag."""
    lists = per_doc.withColumnsRenamed({"doc_id": "id_", "tag": "tag_"})
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_"))
    return docs.join(lists, same, how).drop("id_", "tag_")


def covered_runs(docs: DataFrame, words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tag, start, end): pieces of documents whose words repeat an earlier place, in word numbers.

    Seeds that occur once anywhere are dropped. Places of a seed with the same words all
    around, as far as a least repeat reaches, are one class: all but the first of a class
    repeat it as a whole. The first ones of different classes of a seed are then extended
    both ways, so many words before and the rest behind: whoever agrees with an earlier one
    over ``words`` words repeats it there. Classes and extensions are groups of equal keys
    with their least place, which map tasks combine, so no pairs within a group are made.
    Two hashes of 64 bits, of the seed and of all words, stand for the words.
    """
    k = seed_words(words)
    seeds = in_arrow(docs.select("text"), _seed_counts(words), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    seeds = stored(seeds.where("n > 1").select("seed"), "seeds")
    places = stored(in_arrow(docs, _seed_places(words), _PLACES).join(seeds, "seed", "left_semi"), "seed-places")
    place = F.struct("doc_id", "tag", "pos")
    around = ["seed", "context"]
    classes = stored(places.groupBy(*around).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    whole = (
        places.join(classes.where("n > 1").select(*around, "first"), around)
        .where(~place.eqNullSafe(F.col("first")))
        .select("doc_id", "tag", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + k + F.col("behind")).alias("end"))
    )
    several = stored(classes.groupBy("seed").count().where("count > 1").select("seed"), "open-seeds")
    # As many a document as it has seeds.
    wanted = (
        classes.join(several, "seed", "left_semi")
        .groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.tag").alias("tag"))
        .agg(F.collect_list("first.pos").alias("wanted"))
    )
    runs = stored(in_arrow(_with_texts(docs, wanted, "inner"), _runs_of_seeds(words), _RUNS), "runs")
    begin = F.struct("doc_id", "tag", "start")
    least = runs.groupBy("seed", "key").agg(F.min(begin).alias("least"), F.count(F.lit(1)).alias("n"))
    least = stored(least.where("n > 1").select("seed", "key", "least"), "extensions")
    part = (
        runs.join(least, ["seed", "key"])
        .where(~begin.eqNullSafe(F.col("least")))
        .select("doc_id", "tag", "start", (F.col("start") + words).alias("end"))
    )
    return whole.unionByName(part)


_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start:int,end:int>>, kept string"


def _remove(with_text: bool):
    names = [part.split(" ")[0] for part in _KEPT.split(", ")]
    repeat = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            columns = [[] for _ in range(5)]
            for text, starts, ends in zip(_texts(batch), *(batch.column(c).to_pylist() for c in ("starts", "ends")), strict=True):
                words, spans = text.split(), []
                kept = words
                if starts:
                    change = np.bincount(starts, minlength=len(words) + 1) - np.bincount(ends, minlength=len(words) + 1)
                    inside = np.cumsum(change[:-1]) > 0
                    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).tolist()
                    spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    kept = list(compress(words, (~inside).tolist()))
                joined = b" ".join(kept)
                values = (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), spans, joined.decode() if with_text else None)
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), repeat, pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    return run


def remove_repeats(
    df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = MIN_WORDS, with_text: bool = True
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, repeats, kept): each document without what repeats an earlier place.

    A word is removed if it lies in ``words`` words in a row that also start earlier: in a
    document with a smaller id, or before in the same one. All is judged on the input. ASCII
    white space separates words, which count as they are. ``repeats`` are the maximal runs
    of removed words, by word numbers; ``kept`` is null without ``with_text``.

    A null text has no words. Documents without an id are the earliest. Rows equal in id and
    text are one document; different texts of one id are documents ordered by a hash of the
    text. Other columns are not looked at; an empty table gives no rows.
    """
    docs = df.select(column(doc).cast("long").alias("doc_id"), column(text).alias("text"))
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.withColumn("tag", F.lit(0).cast("long"))
    else:
        tagged = docs.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
        docs = stored(tagged.groupBy("doc_id", "tag").agg(F.min("text").alias("text")), "documents")
    runs = covered_runs(docs.where(F.col("text").isNotNull()), words)
    # A few rows for each seed of a document, at most.
    per_doc = runs.groupBy("doc_id", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    joined = _with_texts(docs, per_doc, "left").select("doc_id", "text", "starts", "ends")
    return in_arrow(joined, _remove(with_text), _KEPT)


SQL = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, s, list_slice(w, s, s + 19) AS run
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM texts)
), later AS (
    SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, s) > 1
), removed AS (
    SELECT doc_id, list(DISTINCT i) AS places FROM (SELECT doc_id, unnest(range(s, s + 20)) AS i FROM later) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(
           list_transform(w, lambda x, i: CASE WHEN list_contains(places, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL), ' ') END) AS kept_sha256
FROM texts LEFT JOIN removed USING (doc_id)
"""
