"""Similar documents by their sets of word n-grams, joined by tries."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column
from .common import HASHED_BYTES, mix, slices, small_batches, stored, texts_in_arrow, word_hashes
from .components import components
from .set_trie import similar

# Size of one trie; a document counts as one, and one more for each 1000 n-grams. A larger
# block is dealt out over several tries.
BLOCK_DOCS = 4000
# Slots of the filter that keeps documents outside all blocks from being moved: a table of
# at most so many numbers.
FILTER_SLOTS = 1 << 20
# Documents whose keys are compared before any are shuffled.
MEETING_ROWS = 4000
_MOST_IN_PART = 8


def ngram_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct hashes of the word n-grams of each text, ascending.

    A text of fewer than ``n`` words has one, its whole sequence; one without words none.
    """
    salts = mix(np.arange(1, n + 2, dtype=np.uint64))
    sets = []
    for start, end in slices(texts, HASHED_BYTES):
        words, ends = word_hashes(texts[start:end])
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for i in range(n):
            grams += mix(words[i : len(words) - n + 1 + i] + salts[i])
        grams = mix(grams)
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            if b - a >= n:
                sets.append(np.unique(grams[a : b - n + 1]))
            else:
                short = mix(words[a:b] + salts[: b - a]).sum(keepdims=True) + salts[n - b + a :][:1]
                sets.append(mix(short) if b > a else np.zeros(0, np.uint64))
    return sets


class Parts:
    """Keys of which two similar sets share at least one.

    The order of the tokens is cut into ``m`` parts. Sets that differ in at most ``k``
    tokens differ in at most ``k`` parts, so of any ``k`` + 1 parts one is the same in both.
    A set gives the key of its fullest parts, at least ``k`` + 1 of them: full parts are
    shared by similar sets and hardly ever by others. ``m`` depends on a class of sizes; a
    set also gives keys of the next class if that holds sizes it can be similar to.
    """

    def __init__(self, percent: int):
        self.percent = percent
        ratio = 0.7 if percent >= 90 else 0.5 + 0.35 * max(0, percent - 50) / 30
        self._bounds = [1]
        while self._bounds[-1] < 1 << 40:
            self._bounds.append(int(self._bounds[-1] / ratio) + 1)

    def _keys(self, tokens: np.ndarray, size_class: int) -> np.ndarray:
        n, largest = len(tokens), self._bounds[size_class + 1] - 1
        most = 2 * largest * (100 - self.percent) // (100 + self.percent)
        parts = most + most // 4 + 1
        differ = (n + min(largest, 100 * n // self.percent)) * (100 - self.percent) // (100 + self.percent)
        place = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        counts = np.diff(begins, append=n)
        enough = np.bincount(np.minimum(counts, _MOST_IN_PART), minlength=_MOST_IN_PART + 1)[::-1].cumsum()[::-1]
        base = np.uint64(size_class << 40)
        full = next((least for least in range(_MOST_IN_PART, 0, -1) if enough[least] > differ), 0)
        sums = np.add.reduceat(mix(tokens), begins)
        found = mix(sums + mix(place[begins] + base))[counts >= full]
        if not full:  # so few parts have tokens that empty ones count too
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), place[begins])
            found = np.concatenate([found, mix(mix(empty + base))])
        return found

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(tokens):
            return tokens
        own = bisect_right(self._bounds, len(tokens)) - 1
        keys = [self._keys(tokens, own)]
        if 100 * len(tokens) >= self.percent * self._bounds[own + 1]:
            keys.append(self._keys(tokens, own + 1))
        return np.concatenate(keys)


def _set_id(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, node, keys): ``node`` is a number from ``set_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(percent)
        for batch in small_batches(batches):
            sets = ngram_sets(_texts(batch), n)
            ids = [_set_id(s) for s in sets]
            keys = [parts.of(s).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([i and int.from_bytes(i[:8], "little", signed=True) for i in ids], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else [], pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_id", "node", "keys"],
            )

    return texts_in_arrow(docs, run, "doc_id long, n_shingles long, set_id binary, node long, keys array<long>")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b): each key of a batch with one node that has it; and, without a key, other nodes that have it too."""
    for batch in small_batches(batches, MEETING_ROWS):
        lists = batch.column("keys")
        nodes = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
        keys = lists.flatten().to_numpy()
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        head = nodes[first][np.cumsum(first) - 1]
        apart = nodes != head
        pairs = np.unique(np.stack([nodes[apart], head[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
        none = np.zeros(len(pairs), bool)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([pa.array(keys[first]), pa.array(np.zeros(len(pairs), np.int64), mask=~none)]),
                pa.array(np.concatenate([nodes[first], pairs[:, 0]])),
                pa.array(np.concatenate([nodes[first], pairs[:, 1]])),
            ],
            ["key", "a", "b"],
        )


def _blocks(sets: DataFrame) -> DataFrame:
    """(node, block): nodes with a chance of a link, and what holds all they can link to."""
    met = texts_in_arrow(sets.where(F.col("node").isNotNull()).select("node", "keys"), _meetings, "key long, a long, b long")
    # A batch, of MEETING_ROWS rows at most, has sent one node a key, so the rows of a key stay few.
    heads = met.where(F.col("key").isNotNull()).select("key", "a")
    across = heads.select("a", F.min("a").over(Window.partitionBy("key")).alias("b")).where("a != b")
    within = met.where(F.col("key").isNull()).select("a", "b")
    edges = stored(across.unionByName(within).distinct(), "candidates")
    return stored(components(edges, "blocks").select(F.col("node"), F.col("root").alias("block")), "blocks")


def _weight(n: Column) -> Column:
    return 1 + F.floor(n / 1000)


def _links(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): labels that links of a task join, b the smallest of them, by a trie for each task.

    ``rows``: task string, doc_id, set_id, label, probe, text. A label is an id. A task ends before the next
    one of its partition begins, so one trie at a time is in memory.
    """

    def join(rows: list[tuple]) -> pa.RecordBatch:
        sets = ngram_sets([t for *_, t in rows], n)
        seen, kept = set(), []
        for at, (doc, set_id, _, _, _) in enumerate(rows):
            # An id may have several rows; each of its sets is taken once, from a row with that text.
            if (doc, set_id) not in seen and _set_id(sets[at]) == set_id:
                seen.add((doc, set_id))
                kept.append(at)
        joined = similar([sets[i] for i in kept], [rows[i][2] for i in kept], [rows[i][3] for i in kept], percent)
        ends = pa.array(list(joined), pa.int64()), pa.array(list(joined.values()), pa.int64())
        return pa.RecordBatch.from_arrays(list(ends), ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for batch in batches:
            names = ("doc_id", "set_id", "label", "probe")
            columns = [batch.column("task").to_pylist(), *(batch.column(c).to_pylist() for c in names), _texts(batch)]
            for key, *row in zip(*columns, strict=True):
                if key != task and held:
                    yield join(held)
                    held = []
                task = key
                held.append(tuple(row))
        if held:
            yield join(held)

    in_tasks = rows.repartition("task").sortWithinPartitions("task")
    return texts_in_arrow(in_tasks, run, "a long, b long")


def _links_of_large_blocks(members: DataFrame, n: int, percent: int, block_docs: int) -> DataFrame:
    """Links of blocks with more documents than a trie takes.

    First all documents are compared with one of their block, chunk by chunk. Those linked
    to it are one component, so among them nothing more is needed. The rest are probes:
    each chunk of them meets each chunk of the linked ones and of the rest.
    """
    columns = ["doc_id", "set_id", "text"]

    def chunks(docs: str) -> Column:
        """Chunks of half the documents of a trie: two of them meet in one."""
        return F.ceil(2 * F.col(docs) / block_docs).cast("int")

    def chunk(docs: str) -> Column:
        return F.pmod(F.xxhash64("doc_id"), chunks(docs)).cast("int")

    def each(docs: str) -> Column:
        return F.explode(F.sequence(F.lit(0), chunks(docs) - 1))

    firsts = members.where("is_first").select(
        "block", *columns, F.lit(True).alias("probe"), each("docs").alias("chunk")
    )
    others = members.where("NOT is_first").select(
        "block", *columns, F.lit(False).alias("probe"), chunk("docs").alias("chunk")
    )
    task = F.concat_ws("/", "block", "chunk").alias("task")
    rows = firsts.unionByName(others).select(task, *columns, F.col("doc_id").alias("label"), "probe")
    near = stored(_links(rows, n, percent), "links")
    linked = near.select(F.col("a").alias("doc_id"), F.lit(True).alias("linked"))
    marked = members.join(linked, "doc_id", "left").withColumn("linked", F.col("is_first") | F.coalesce("linked", F.lit(False)))
    counts = marked.groupBy("block").agg(
        F.sum(F.when(F.col("linked"), F.col("weight")).otherwise(0)).alias("n_linked"),
        F.sum(F.when(~F.col("linked"), F.col("weight")).otherwise(0)).alias("n_rest"),
    )
    placed = marked.drop("docs").join(counts.where("n_rest > 0"), "block")
    rest, core = placed.where("NOT linked"), placed.where("linked")
    label = F.when(F.col("linked"), F.col("block")).otherwise(F.col("doc_id")).alias("label")
    keep = ["block", *columns, label, (~F.col("linked")).alias("probe")]
    with_core, with_rest = F.lit("core").alias("kind"), F.lit("rest").alias("kind")
    tasks = [
        core.select(*keep, with_core, chunk("n_linked").alias("i"), each("n_rest").alias("j")),
        rest.select(*keep, with_core, each("n_linked").alias("i"), chunk("n_rest").alias("j")),
        rest.select(*keep, with_rest, chunk("n_rest").alias("i"), each("n_rest").alias("j")).where("i <= j"),
        rest.select(*keep, with_rest, each("n_rest").alias("i"), chunk("n_rest").alias("j")).where("i < j"),
    ]
    rows = tasks[0]
    for more in tasks[1:]:
        rows = rows.unionByName(more)
    task = F.concat_ws("/", "block", "kind", "i", "j").alias("task")
    return near.unionByName(_links(rows.select(task, *columns, "label", "probe"), n, percent))


def ngram_join(
    df: DataFrame, words: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable by links.

    A document's set holds its distinct ``words``-word n-grams, with ASCII letters in lower
    case; two documents are linked if 100 * intersection >= ``percent`` * union. N-grams are
    ordered by a 64-bit hash. Equal sets are one node. Nodes that share a part of the order
    form blocks which no link leaves (see ``Parts``); in each block the ordered sets form a
    trie, and one walk for each set adds up overlaps along shared beginnings and leaves a
    subtree when the tokens left cannot reach the overlap that a link needs.

    A text without words has an empty set and is linked with nothing, like a null one.
    Each row of ``df`` gives one; an id with several texts is linked by all of them, and a row
    without an id has no component. Other columns are not looked at.
    """
    docs = df.select(column(doc).cast("long").alias("doc_id"), column(text).alias("text"))
    sets = stored(_sets(docs, words, percent), "sets")
    nodes = stored(
        sets.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("set_id", "node")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n")),
        "nodes",
    )
    blocks = _blocks(sets)
    placed = stored(nodes.join(blocks, "node").select("doc_id", "set_id", "block", _weight(F.col("n")).alias("weight")), "placed")
    # The first of a block is its smallest id: a window over blocks would gather a large one.
    sizes = stored(placed.groupBy("block").agg(F.sum("weight").alias("docs"), F.min("doc_id").alias("first")), "sizes")
    members = stored(placed.join(sizes, "block"), "members")
    slot = F.pmod(F.xxhash64("doc_id"), FILTER_SLOTS).cast("int")
    slots = members.select(slot.alias("slot")).distinct()
    # At most FILTER_SLOTS rows of four bytes are broadcast.
    some = docs.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot")
    texts = some.join(members, "doc_id").select(
        "doc_id", "set_id", F.col("first").alias("block"), "docs", "weight", (F.col("doc_id") == F.col("first")).alias("is_first"), "text"
    )
    small = texts.where(F.col("docs") <= block_docs).select(
        F.col("block").cast("string").alias("task"), "doc_id", "set_id", F.col("doc_id").alias("label"), F.lit(True).alias("probe"), "text"
    )
    links = _links(small, words, percent)
    if not members.where(F.col("docs") > block_docs).isEmpty():
        large = stored(texts.where(F.col("docs") > block_docs), "large-blocks")
        links = links.unionByName(_links_of_large_blocks(large, words, percent, block_docs))
    # An id with several sets ties the nodes of all of them, also where it names none.
    own = sets.where(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "set_id")
    several = own.groupBy("doc_id").agg(F.min("set_id").alias("least"), F.max("set_id").alias("most")).where("least != most")
    ties = own.join(stored(several.select("doc_id"), "tied-ids"), "doc_id", "left_semi").join(
        nodes.select("set_id", F.col("doc_id").alias("first")), "set_id"
    )
    links = links.unionByName(ties.where("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    found = components(stored(links, "links"), "components")
    named = nodes.join(found, nodes["doc_id"] == found["node"], "left").select(
        "set_id", F.coalesce("root", "doc_id").alias("component_id")
    )
    return sets.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
