"""Batches of documents of similar length, with the least padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column
from .common import WORD, stored

BUCKETS = 16
BATCH_TOKENS = 65_536
# Documents of a bucket are numbered slice by slice; a slice is a range of a hash of the id.
SLICE_DIGITS = 3
SLICES = 16**SLICE_DIGITS
CHUNK_ROWS = 10_000


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space, and one end."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long") + 1


def best_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The bucket lengths with the least padding, ascending; the last is the longest length.

    ``histogram`` has (length, documents) in ascending order. A document is padded to the
    smallest bound that is not below its length. Of equal solutions, that with the smaller
    bounds from the top down is taken.

    Let C and S be the running sums of documents and of their lengths. A bucket from length
    i (not in it) to j pads j (C_j - C_i) - (S_j - S_i) tokens, so with one more bucket the
    least padding up to j is j C_j - S_j + min over i of (best_i + S_i - j C_i): the lowest
    of a set of lines at j. Their slopes fall and j grows, so each line is looked at once.
    """
    lengths = [0] + [n for n, _ in histogram]
    counts, sums = [0], [0]
    for n, c in histogram:
        counts.append(counts[-1] + c)
        sums.append(sums[-1] + n * c)
    buckets = min(buckets, len(histogram))
    best = [n * c - s for n, c, s in zip(lengths, counts, sums, strict=True)]
    came_from = []
    for used in range(2, buckets + 1):
        lines: list[tuple[int, int, int]] = []  # (slope, height, i), the lower envelope
        now, sources, at = [0] * len(lengths), [0] * len(lengths), 0
        for j in range(used, len(lengths)):
            i = j - 1
            slope, height = -counts[i], best[i] + sums[i]
            while len(lines) > 1:
                (s1, h1, _), (s2, h2, _) = lines[-2:]
                if (height - h1) * (s1 - s2) > (h2 - h1) * (s1 - slope):
                    break
                lines.pop()
            lines.append((slope, height, i))
            at = min(at, len(lines) - 1)
            x = lengths[j]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            slope, height, sources[j] = lines[at]
            now[j] = x * counts[j] - sums[j] + slope * x + height
        best = now
        came_from.append(sources)
    bounds, j = [], len(lengths) - 1
    for sources in reversed(came_from):
        bounds.append(lengths[j])
        j = sources[j]
    return ([lengths[j], *reversed(bounds)]) if histogram else []


def pack(
    df: DataFrame,
    tokens: Column | None = None,
    buckets: int = BUCKETS,
    batch_tokens: int = BATCH_TOKENS,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, position): a place for every row of ``df``.

    ``tokens`` is the length of a row, by default its words and one end. Bucket lengths come
    from the histogram of all rows and leave the least padding. Each row is padded to
    ``bucket_tokens``; a batch of a bucket takes as many rows as fit into ``batch_tokens``, at
    least one, so a longer document is a batch alone and is never cut. Rows of a bucket are
    in the order of a hash of the id, which mixes sources.

    A null text is an empty one, of one token. Each of several equal rows has its place, and
    rows without an id come as one with an empty id would. Other columns are not looked at.
    The driver gets the histogram: n distinct lengths need n * n / 2 tokens at least, so there
    are at most the square root of twice the tokens.
    """
    digits = F.substring(F.md5(F.coalesce(column(doc).cast("string"), F.lit("")).cast("binary")), 1, SLICE_DIGITS)
    rows = df.select(
        column(doc).alias("doc_id"),
        (word_tokens(column(text)) if tokens is None else tokens.cast("long")).alias("n_tokens"),
        F.conv(digits, 16, 10).cast("int").alias("slice"),
    )
    rows = stored(rows, "lengths")  # the texts are read once
    histogram = [(r[0], r[1]) for r in rows.groupBy("n_tokens").count().orderBy("n_tokens").collect()]
    bounds = best_bounds(histogram, buckets)
    limits = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array(F.lit(0).cast("long"))
    placed = rows.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("n_tokens")))).withColumn(
        "bucket_tokens", F.get(limits, F.col("bucket"))
    )
    # Rows of one id and length are alike: they are counted in the map tasks and placed together.
    counted = stored(placed.groupBy("bucket", "bucket_tokens", "slice", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("rows")), "rows")
    # At most buckets * SLICES rows: a bucket is numbered without gathering it.
    sizes = counted.groupBy("bucket", "slice").agg(F.sum("rows").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("bucket", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    in_slice = Window.partitionBy("bucket", "slice").orderBy("doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce("earlier", F.lit(0))
    numbered = (
        counted.withColumn("earlier", F.sum("rows").over(in_slice))
        .join(F.broadcast(offsets), ["bucket", "slice"])
        .select("doc_id", "n_tokens", "bucket", "bucket_tokens", first.alias("first"), "rows")
    )
    # Very many alike rows are dealt out in chunks before each gets its number.
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / CHUNK_ROWS)))
    many = numbered.where(F.col("rows") > CHUNK_ROWS).withColumn("chunk", chunk)
    many = many.withColumn("first", F.col("first") + F.col("chunk") * CHUNK_ROWS).withColumn(
        "rows", F.least(F.lit(CHUNK_ROWS), F.col("rows") - F.col("chunk") * CHUNK_ROWS)
    )
    chunks = numbered.where(F.col("rows") <= CHUNK_ROWS).unionByName(many.repartition("bucket", "first").drop("chunk"))
    number = F.col("first") + F.col("at")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bucket_tokens"))).cast("long")
    return chunks.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.floor(number / capacity).alias("batch"),
        F.pmod(number, capacity).alias("position"),
    )


def sql(buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, rows: str = "documents") -> str:
    """The same by trying every pair of neighbouring bounds."""
    steps = [
        f"""
d{k} AS MATERIALIZED (SELECT b.j, min(struct_pack(cost := d.best.cost + b.n * (b.c - a.c) - (b.s - a.s), source := a.j)) AS best
  FROM p b JOIN d{k - 1} d ON d.j < b.j JOIN p a ON a.j = d.j GROUP BY b.j)"""
        for k in range(2, buckets + 1)
    ]
    every = " UNION ALL ".join(f"SELECT {k} AS k, j, best.source AS source FROM d{k}" for k in range(1, buckets + 1))
    return f"""
WITH RECURSIVE lengths AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n_tokens,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {SLICE_DIGITS}))::INT AS slice FROM {rows}),
h AS (SELECT n_tokens AS n, count(*) AS docs, row_number() OVER (ORDER BY n_tokens) AS j FROM lengths GROUP BY n_tokens),
p AS MATERIALIZED (SELECT j, n, (sum(docs) OVER (ORDER BY j))::BIGINT AS c, (sum(docs * n) OVER (ORDER BY j))::BIGINT AS s FROM h),
d1 AS MATERIALIZED (SELECT j, struct_pack(cost := n * c - s, source := 0::BIGINT) AS best FROM p),{",".join(steps)},
every AS MATERIALIZED ({every}),
chosen AS (
  SELECT least({buckets}, max(j)) AS k, max(j) AS j FROM p
  UNION ALL SELECT c.k - 1, e.source FROM chosen c JOIN every e ON e.k = c.k AND e.j = c.j WHERE c.k > 1),
bounds AS (SELECT k - 1 AS bucket, n AS bound, lag(n, 1, 0) OVER (ORDER BY k) AS below FROM chosen JOIN p USING (j)),
placed AS (
  SELECT doc_id, n_tokens, bucket::INT AS bucket, bound::BIGINT AS bucket_tokens, greatest(1, {batch_tokens} // bound) AS capacity,
         row_number() OVER (PARTITION BY bucket ORDER BY slice, doc_id, n_tokens) - 1 AS number
  FROM lengths JOIN bounds ON n_tokens > below AND n_tokens <= bound)
SELECT doc_id, n_tokens, bucket, bucket_tokens, number // capacity AS batch, number % capacity AS position FROM placed
"""
