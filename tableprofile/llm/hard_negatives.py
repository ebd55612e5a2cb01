"""Hard negatives of anchors, by exact integer inner products from matrices of residues."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column
from .common import in_arrow, let_workers_import, stored

# The eight largest primes p for which SLICE products of centred residues,
# each at most ((p - 1) / 2) ** 2, add up to less than 2 ** 24, so float32 is exact.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983, 977)
SLICE = 64

SCALE = 256
BLOCK_ROWS = 1024  # vectors in a row of the table of blocks
LANE_BLOCKS = 8  # blocks that one task compares with one block of anchors
ANCHOR_ROWS = 2048  # anchors in a block
STEP_ANCHORS = 512  # anchors whose scores a task holds at once
LONGEST = float(1 << 62)  # largest squared length of an integer vector
LOWEST = np.iinfo(np.int64).min


def _square(matrix: np.ndarray) -> int:
    """At least the largest squared length of a row."""
    return int(np.ceil((matrix.astype(np.float64) ** 2).sum(1).max(initial=0.0) * (1 + 1e-9)))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of two integer matrices, as 64-bit integers.

    For each of as many primes as the longest rows need, residues are multiplied as float32
    matrices, 64 components at a time. The balanced mixed-radix digits of the residues then
    give the signed product. A narrower matrix counts as filled up with zeros.
    """
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = 2 * (isqrt(_square(a) * _square(b)) + 1)  # no product is longer, by Cauchy and Schwarz
    total, radix, digits = np.zeros((len(a), len(b)), np.int64), 1, []
    for p in PRIMES:
        half = (p - 1) // 2
        left, right = (((m + half) % p - half).astype(np.float32) for m in (a, b))
        residue = np.zeros(total.shape, np.int32)
        for at in range(0, width, SLICE):
            residue += (left[:, at : at + SLICE] @ right[:, at : at + SLICE].T).astype(np.int32)
            residue %= p
        known, place = np.zeros_like(residue), 1
        for q, digit in digits:  # what the digits so far are, modulo p
            known += digit * place % p
            place = place * q % p
        digit = ((residue - known) * pow(radix % p, -1, p) + half) % p - half if radix > 1 else (residue + half) % p - half
        # Wraps only where digits cancel: the product itself has less than 63 bits.
        total += digit.astype(np.int64) * np.array(radix % (1 << 64), np.uint64).astype(np.int64)
        digits.append((p, digit))
        radix *= p
        if radix > bound:
            return total
    raise ValueError("vectors too long for exact products")


def first_columns(scores: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the first ``k`` kept columns of each row: largest scores, then smaller columns."""
    if scores.shape[1] > k:
        masked = np.where(keep, scores, LOWEST)
        masked.partition(scores.shape[1] - k, axis=1)
        keep = keep & (scores >= masked[:, -k][:, None])
    rows, columns = np.nonzero(keep)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], columns[first]


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers, filled up with zeros to the longest."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


_BLOCK = "block long, ids binary, labels binary, width int, kind string, components binary"


def _block(block: int, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    """One row with vectors in the order of their ids, in the narrowest integers that hold them."""
    order = np.argsort(ids, kind="stable")
    most = int(np.abs(matrix).max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    values = [block, ids[order].tobytes(), labels[order].tobytes(), matrix.shape[1], kind, matrix[order].astype(kind).tobytes()]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary()]
    names = [part.split()[0] for part in _BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["components"], row["kind"]).astype(np.int64).reshape(len(ids), row["width"])


def _cut(rows: int):
    """A function for ``mapInArrow`` that packs ``rows`` vectors of a task into each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0

        def pack(table: pa.Table) -> pa.RecordBatch:
            ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
            return _block(block, ids, labels, _matrix(table.column("vector")))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                table = pa.Table.from_batches(held)
                for at in range(0, n - rows + 1, rows):
                    yield pack(table.slice(at, rows))
                    block += 1
                held, n = table.slice(n - n % rows).to_batches(), n % rows
        if n:
            yield pack(pa.Table.from_batches(held))

    return run


def _pack_anchors(table: pa.Table) -> pa.Table:
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    return pa.Table.from_batches([_block(table.column("group")[0].as_py(), ids, labels, _matrix(table.column("vector")))])


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    return vector.isNotNull() & finite & (square <= LONGEST / SCALE**2 / 4)


def labelled_vectors(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, with integer components; one row an id."""
    rows = df.select(
        column(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), column(vector).cast("array<double>").alias("vector")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(SCALE)))))
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    best = F.min(F.struct("label", "vector")).alias("best")
    return rows.groupBy("vec_id").agg(best).select("vec_id", "best.label", "best.vector")


def _same_label(anchors: tuple, rows: tuple, scores: np.ndarray, at: int, k: int, _) -> list[np.ndarray]:
    """Columns (anchor, other, score) of the first ``k`` others with an anchor's label."""
    (own_ids, own_labels, _), (ids, labels, _) = anchors, rows
    own_ids, own_labels = own_ids[at : at + len(scores)], own_labels[at : at + len(scores)]
    keep = (own_labels[:, None] == labels) & (own_ids[:, None] != ids)
    a, b = first_columns(scores, keep, k)
    return [own_ids[a], ids[b], scores[a, b]]


def _other_label(anchors: tuple, rows: tuple, scores: np.ndarray, at: int, k: int, positives: list) -> list[np.ndarray]:
    """Columns (anchor, positive, other, score, positive's score) of the first ``k`` in each positive's range."""
    (own_ids, own_labels, _), (ids, labels, _) = anchors, rows
    own_ids, own_labels = own_ids[at : at + len(scores)], own_labels[at : at + len(scores)]
    differs = own_labels[:, None] != labels
    out = []
    of, their_ids, their_scores, low, high = positives
    for place in range(int(np.bincount(of, minlength=1).max(initial=0))):
        # The positives at this place of each anchor's list.
        first = np.searchsorted(of, np.arange(at, at + len(scores)))
        there = np.searchsorted(of, np.arange(at, at + len(scores)), "right") > first + place
        mine = np.flatnonzero(there)
        one = first[mine] + place
        part = scores[mine]
        keep = differs[mine] & (part >= low[one][:, None]) & (part <= high[one][:, None])
        a, b = first_columns(part, keep, k)
        out.append([own_ids[mine[a]], their_ids[one[a]], ids[b], part[a, b], their_scores[one[a]]])
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5


def _search(anchors: DataFrame, blocks: DataFrame, groups: int, lanes: int, k: int, schema: str, select) -> DataFrame:
    """Every block of anchors against every block of vectors, a lane of blocks a task.

    ``select`` finds at most ``k`` rows of a lane for each key, that is for each combination
    of the columns before the last but one or two; only they leave the task.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    n_keys = len(names) - 2 if len(names) == 3 else 2

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] * len(names)]
        for anchor_row in left.to_pylist() if right.num_rows else []:
            own, positives = _unpack(anchor_row), None
            if anchor_row.get("positives") is not None:
                positives = _ranges(own[0], anchor_row["positives"])
            for i in range(right.num_rows):
                rows = _unpack(right.slice(i, 1).to_pylist()[0])
                for at in range(0, len(own[0]), STEP_ANCHORS):
                    found.append(select(own, rows, products(own[2][at : at + STEP_ANCHORS], rows[2]), at, k, positives))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        other, score = columns[n_keys], columns[n_keys + 1]
        order = np.lexsort((other, -score, *reversed(columns[:n_keys])))
        columns = [c[order] for c in columns]
        changes = np.ones(len(order), bool)
        changes[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:n_keys]])
        begins = np.flatnonzero(changes)
        first = np.arange(len(order)) - begins[np.cumsum(changes) - 1] < k if len(order) else changes
        return pa.Table.from_arrays([pa.array(c[first], pa.int64()) for c in columns], names)

    let_workers_import(blocks.sparkSession)
    lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane")
    corpus = blocks.select("*", lane).withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    asked = anchors.withColumnRenamed("block", "anchor_block").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    keys = ["anchor_block", "lane"]
    return asked.groupBy(*keys).cogroup(corpus.groupBy(*keys)).applyInArrow(run, schema)


def _ranges(ids: np.ndarray, positives: list[dict]) -> list[np.ndarray]:
    """Positives in the order of the anchors: (place of the anchor, id, score, lowest, highest negative score)."""
    place = {int(v): i for i, v in enumerate(ids.tolist())}
    rows = sorted((place[p["anchor_id"]], p["rank"], p["positive_id"], p["score"]) for p in positives)
    low = [-(-3 * s // 10) for *_, s in rows]  # 30 * s <= 100 * negative
    high = [9 * s // 10 for *_, s in rows]  # 100 * negative <= 90 * s
    columns = [[r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows], low, high]
    return [np.array(c, np.int64) for c in columns]


def _nothing(df: DataFrame) -> DataFrame:
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return df.sparkSession.createDataFrame([], schema)


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    label: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become ``floor(256 * x)``; a score is the exact integer inner product, higher
    ones come first and equal ones by id. The positives of an anchor are its first others of
    the same label. For each, the first negatives of another label whose score is between
    three and nine tenths of the positive's are returned; a positive without any gives no
    row. ``is_anchor`` is a condition on ``vec_id``; ``label`` one on the columns of ``df``.

    The anchors are a stated query set against all rows: blocks of both meet, and a task
    hands on only the best of its lane of blocks. The selection is a rank over these.

    Rows without an id or a label, and vectors that are null or hold a null or non-finite
    component take no part, nor do vectors of a length beyond 4 million, whose products
    would not fit 64 bits. A shorter vector counts as filled up with zeros, an empty one
    scores 0. Of several rows with one id, that with the smallest label and vector takes
    part. Other columns are not looked at; an empty table gives no rows.
    """
    vectors = stored(labelled_vectors(df, key, vector, label), "labelled")
    n_anchors = vectors.where(is_anchor).count()
    if not n_anchors:
        return _nothing(df)
    groups = -(-n_anchors // anchor_rows)
    blocks = stored(in_arrow(vectors, _cut(block_rows), _BLOCK), "vector-blocks")
    lanes = max(1, -(-blocks.count() // LANE_BLOCKS))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("long")
    grouped = vectors.where(is_anchor).select("vec_id", "label", "vector", group.alias("group"))
    let_workers_import(df.sparkSession)
    anchors = stored(grouped.groupBy("group").applyInArrow(_pack_anchors, _BLOCK), "anchor-blocks")

    found = _search(anchors, blocks, groups, lanes, positives, "anchor_id long, positive_id long, score long", _same_label)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    chosen = stored(found.withColumn("rank", rank).where(F.col("rank") <= positives), "positives")

    # A block has a bounded number of anchors, and each has a few positives.
    per_block = chosen.groupBy(F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("long").alias("block")).agg(
        F.collect_list(F.struct("anchor_id", "rank", "positive_id", "score")).alias("positives")
    )
    schema = "anchor_id long, positive_id long, negative_id long, negative_score long, positive_score long"
    found = _search(anchors.join(per_block, "block"), blocks, groups, lanes, negatives, schema, _other_label)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def contract_label(key: str = "vec_id", label: str = "label") -> Column:
    """Fixed by the contract: every seventh row counts as one of the next label."""
    own = column(label).cast("long")
    return F.when(column(key) % 7 == 0, (own + 1) % 10).otherwise(own)


SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
           list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
    FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
    WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
) WHERE rank <= 10
"""
