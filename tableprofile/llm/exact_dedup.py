"""Exact duplicates by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import column
from .common import stored

BLOCK_BYTES = 2048


def _clashes(keys: DataFrame) -> DataFrame:
    """(hash, key, tie): the sorted distinct keys of each hash that several keys share.

    ``keys`` has (hash, key). Map tasks collapse repeated keys first, so a frequent key
    sends one row a task. A hash holds one key in practice, and this table is empty.
    """
    return (
        keys.groupBy("hash")
        .agg(F.array_sort(F.collect_set("key")).alias("keys"))
        .where(F.size("keys") > 1)
        .select("hash", F.posexplode("keys").alias("tie", "key"))
    )


def _named(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with (hash, tie) in place of (hash, key): equal exactly where the keys are equal.

    The name of a key is its hash and its place among the sorted distinct keys of that hash.
    """
    known = stored(_clashes(rows.select("hash", "key")), label).withColumnsRenamed({"hash": "_hash", "key": "_key"})
    same = (F.col("hash") == F.col("_hash")) & (F.col("key") == F.col("_key"))
    return rows.join(known, same, "left").withColumn("tie", F.coalesce("tie", F.lit(0))).drop("key", "_hash", "_key")


def _blocks(text: Column, n: Column, block_bytes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * block_bytes + 1, F.lit(block_bytes)))


def exact_dedup(
    df: DataFrame, doc: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): one row per document.

    Each text is cut into blocks of ``block_bytes`` bytes. Equal blocks get one integer
    name; then adjacent names are paired and each distinct pair gets a name, until every
    document has one. Two documents have the same name at the same level exactly if their
    texts are equal: a name is a 64-bit hash with the place among the sorted distinct keys
    of that hash, so hash collisions are told apart.

    Of equal texts, the row with the largest document id stays. A null text is an empty
    one. Rows equal in id and text are one document; one id with two texts gives two rows.
    Documents without an id form groups like others; a group of them alone has a null
    ``keep_id``. Other columns are not looked at.
    """
    docs = df.select(column(doc).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text")).select(
        "doc_id",
        F.sha2("text", 256).alias("sha"),
        F.col("text").cast("binary").alias("bytes"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int").alias("n"),
    )
    blocks = docs.select(
        "doc_id", "sha", "n", F.posexplode(_blocks(F.col("bytes"), F.col("n"), block_bytes)).alias("pos", "key")
    ).withColumn("hash", F.xxhash64("key"))
    rows = stored(_named(blocks, "block-names"), "blocks")
    level, finished = 0, []
    while True:
        finished.append(rows.where("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "hash", "tie"))
        longer = rows.where("n > 1")
        if longer.isEmpty():
            break
        name = F.struct("hash", "tie")
        no_name = F.struct(F.lit(0).cast("long").alias("hash"), F.lit(-1).alias("tie"))
        pairs = (
            longer.groupBy("doc_id", "sha", "n", F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, name)).alias("left"),
                F.max(F.when(F.col("pos") % 2 == 1, name)).alias("right"),
            )
            .select(
                "doc_id",
                "sha",
                F.ceil(F.col("n") / 2).cast("int").alias("n"),
                "pos",
                # A last name without a partner is paired with a tie that no name has.
                F.struct("left", F.coalesce("right", no_name).alias("right")).alias("key"),
            )
            .withColumn("hash", F.xxhash64("key"))
        )
        level += 1
        rows = stored(_named(stored(pairs, "pairs"), "pair-names"), "blocks")
    identity = finished[0]
    for more in finished[1:]:
        identity = identity.unionByName(more)
    identity = stored(identity.distinct(), "identities")
    groups = identity.groupBy("level", "hash", "tie").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    # Written, so that the join shuffles both sides anew and a large group can be split.
    groups = stored(groups, "groups")
    return identity.join(groups, ["level", "hash", "tie"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents)
WINDOW same AS (PARTITION BY text)
"""
