"""The trie of all conversation prefixes, by ROLLUP over columns of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column
from .common import in_arrow, stored

BLOCK_TURNS = 8  # columns of a ROLLUP
# Consecutive blocks, or nodes, of one conversation that a running total covers at once.
SPAN = 1 << 16
CHUNK_IDS = 1 << 16  # ids in a piece of the text that a node's hash is of

_SPACE = r"\x20\x09-\x0D"


def _words(text: Column) -> Column:
    """Number of words, separated by ASCII white space."""
    return F.regexp_count(text, F.lit(f"[^{_SPACE}]+"))


def turn_ids(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, id, words, place): each turn with a digest of its role and text, and its words."""
    role_, text_ = (F.coalesce(column(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary"), 256)
    return df.where(column(conv).isNotNull()).select(
        column(conv).cast("long").alias("conv_id"),
        column(turn).alias("turn"),
        F.unhex(F.substring(digest, 1, 32)).alias("id"),
        _words(text_).cast("long").alias("words"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, the place of each in its conversation, from 1.

    Rows are dealt out by ranges of (conversation, turn), so that a conversation with very
    many turns is numbered in slices. The few conversations that lie in several slices, at
    most two for each, get what stands in their earlier slices added.
    """
    given = stored(turns, "turns").withColumn("place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("turn"), F.asc("id"), F.asc("place")]
    dealt = given.repartitionByRange(F.asc("conv_id"), *order).withColumn("slice", F.spark_partition_id())
    sliced = stored(dealt, "sliced-turns")
    several = sliced.groupBy("conv_id", "slice").count()
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = several.withColumn("before", F.sum("count").over(earlier)).where("before > 0").select("conv_id", "slice", "before")
    in_slice = F.row_number().over(Window.partitionBy("conv_id", "slice").orderBy(*order))
    return (
        sliced.withColumn("in_slice", in_slice.cast("long"))
        .join(before, ["conv_id", "slice"], "left")
        .select("conv_id", (F.col("in_slice") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "words")
    )


def rebuild(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each has got the head of another.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % every``, where ``h`` is
    the crc32 of ``c`` as text modulo ``most``, and goes on with its own turns after its
    first ``h``. ``turns``: (conv_id, pos, id, words); conversations: (conv_id, n), those
    without a turn included.
    """
    own_id = F.col("conv_id")
    h = F.pmod(F.crc32(own_id.cast("string").cast("binary")), F.lit(most))
    counts = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    heads = turns.where((F.col("pos") < most) & (own_id % every == 0)).withColumnRenamed("conv_id", "base")
    known = counts.where(own_id % every == 0).select(own_id.alias("base"), F.col("own").alias("of_base"))
    # At most 2 * every - 1 conversations have one base.
    convs = stored(
        counts.select("conv_id", "own", h.alias("h"), (own_id - own_id % every).alias("base"))
        .join(known, "base", "left")
        .withColumn("copied", F.least("h", F.coalesce("of_base", F.lit(0)))),
        "conversations",
    )
    copies = convs.where("copied > 0").join(heads, "base").where("pos <= copied").select("conv_id", "pos", "id", "words")
    kept = turns.where(F.col("pos") > h)
    # Only where the base had fewer turns than asked for does this move a turn.
    shift = convs.where("copied < h").select("conv_id", (F.col("h") - F.col("copied")).alias("shift"))
    moved = kept.join(shift, "conv_id", "left").select(
        "conv_id", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("pos"), "id", "words"
    )
    n = F.col("copied") + F.greatest(F.lit(0), F.col("own") - F.col("h"))
    return copies.unionByName(moved), convs.select("conv_id", n.alias("n"))


def _path(seed: int, pos: Column, turn: Column) -> Column:
    """What a turn at a depth adds to the name of a path."""
    return F.xxhash64(F.lit(seed), pos, turn)


def _turn(i: int) -> str:
    return f"t{i}"


def turn_blocks(turns: DataFrame, width: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, block, a, b, t1, ..): ``width`` turns a row; (a, b) name the node before the first.

    The name of a node is two 64-bit sums (exclusive or) of hashes of each depth with its
    turn, so the names before all blocks come from running totals. Null columns stand behind
    the last turn.
    """
    block = F.floor((F.col("pos") - 1) / width).cast("long")
    at = (F.col("pos") - 1) % width
    turn = F.struct("id", "words")
    names = [F.bit_xor(_path(seed, F.col("pos"), F.col("id"))).alias(c) for seed, c in ((1, "x"), (2, "y"))]
    rows = turns.withColumn("block", block).groupBy("conv_id", "block").agg(
        *names, *(F.max(F.when(at == i, turn)).alias(_turn(i + 1)) for i in range(width))
    )
    rows = stored(rows, "blocks").withColumn("span", F.floor(F.col("block") / SPAN))
    spans = rows.groupBy("conv_id", "span").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    before_span = spans.where("span > 0 OR sx IS NOT NULL").select(
        "conv_id", "span", F.bit_xor("sx").over(earlier).alias("sx"), F.bit_xor("sy").over(earlier).alias("sy")
    ).where("sx IS NOT NULL")
    in_span = Window.partitionBy("conv_id", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")

    def before(own: str, span: str) -> Column:
        return F.coalesce(own, zero).bitwiseXOR(F.coalesce(span, zero))

    return (
        rows.withColumn("a", F.bit_xor("x").over(in_span))
        .withColumn("b", F.bit_xor("y").over(in_span))
        .join(before_span, ["conv_id", "span"], "left")
        .select("conv_id", "block", before("a", "sx").alias("a"), before("b", "sy").alias("b"), *(_turn(i + 1) for i in range(width)))
    )


def _roll_up(blocks: DataFrame, values: str, width: int) -> DataFrame:
    """One row a node of depth 1 or more: (block, a, b, t1, .., level, values)."""
    turns = ", ".join(_turn(i + 1) for i in range(width))
    # A level groups its turn and those before it: grouping_id has a bit for each one behind.
    level = f"{width} - bit_count(grouping_id())"
    there = " ".join(f"WHEN {i + 1} THEN {_turn(i + 1)} IS NOT NULL" for i in range(width))
    return blocks.sparkSession.sql(
        f"""
        SELECT * FROM (
            SELECT block, a, b, {turns}, {level} AS level, {values}
            FROM {{blocks}} GROUP BY block, a, b, ROLLUP({turns})
        ) WHERE CASE level {there} ELSE false END
        """,
        blocks=blocks,
    )


def _named(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes with their depth, name (a, b) and the name of their parent (pa, pb)."""
    first = F.col("block") * width

    def name(start: str, seed: int, short: int) -> Column:
        out = F.col(start)
        for i in range(width):
            step = _path(seed, first + (i + 1), F.col(_turn(i + 1)).getField("id"))
            out = out.bitwiseXOR(F.when(F.col("level") - short > i, step).otherwise(F.lit(0).cast("long")))
        return out

    words = F.coalesce(*(F.when(F.col("level") == i + 1, F.col(_turn(i + 1)).getField("words")) for i in range(width)))
    rest = [c for c in nodes.columns if c not in {"block", "a", "b", "level", *(_turn(i + 1) for i in range(width))}]
    return nodes.select(
        (first + F.col("level")).alias("depth"),
        name("a", 1, 0).alias("a"),
        name("b", 2, 0).alias("b"),
        name("a", 1, 1).alias("pa"),
        name("b", 2, 1).alias("pb"),
        words.alias("words"),
        *rest,
    )


def _id_hashes(ends: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """(depth, a, b, ends_sha256): of the ids that end at a node, ascending and joined by commas.

    Ids are dealt out by ranges of (node, id); a task hands on the text of its part of a node
    in pieces, and the hash of a node reads its pieces one after the other, so a node where
    very many conversations end is never held at once.
    """
    keys = ["depth", "a", "b"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"depth": k[0], "a": k[1], "b": k[2], "first": ids[0], "piece": ",".join(map(str, ids))} for k, ids in done], PIECES
            )

        key, ids = None, []
        for batch in batches:
            done = []
            for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*keys, "conv_id")), strict=True):
                if key is not None and (own != key or len(ids) >= chunk_ids):
                    done.append((key, ids))
                    ids = []
                key = own
                ids.append(conv)
            if done:
                yield rows(done)
        if ids:
            yield rows([(key, ids)])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip([*keys, "ends_sha256"], (*k, h), strict=True)) for k, h in done], HASHES)

        key, state = None, None
        for batch in batches:
            done = []
            for *own, piece in zip(*(batch.column(c).to_pylist() for c in (*keys, "piece")), strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(piece.encode())
            if done:
                yield rows(done)
        if key is not None:
            yield rows([(key, state.hexdigest())])

    node = [("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]
    PIECES = pa.schema([*node, ("first", pa.int64()), ("piece", pa.string())])
    HASHES = pa.schema([*node, ("ends_sha256", pa.string())])
    sliced = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    cut = in_arrow(sliced, pieces, "depth long, a long, b long, first long, piece string")
    in_order = cut.repartition(*keys).sortWithinPartitions(*keys, "first")
    return in_arrow(in_order, hashes, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, width: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row a node.

    ``turns``: (conv_id, pos, id, words) with places from 1 without gaps; ``conversations``:
    (conv_id, n), one row for each, those without a turn included.

    A first ROLLUP gives every node its members. The smallest of them owns it, and owns the
    nodes below on its own path: so what a conversation saves, and whether it ends in a
    leaf, is one number a conversation. A second ROLLUP adds these up for all subtrees; what
    the owner saves above a node is taken off again.
    """
    blocks = stored(turn_blocks(turns, width), "named-blocks")
    members = "min(conv_id) AS conv_id, count(*) AS n_convs"
    nodes = stored(_named(_roll_up(blocks, members, width), width), "nodes")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"),
        *(F.lit(0).cast("long").alias(c) for c in ("a", "b")),
        *(F.lit(None).cast("long").alias(c) for c in ("pa", "pb")),
        F.lit(0).cast("long").alias("words"),
        "conv_id",
        "n_convs",
    )
    node = ["depth", "a", "b"]
    all_nodes = stored(nodes.unionByName(root), "all-nodes")

    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    own_value = (F.col("n_convs") - 1) * F.col("words")
    valued = stored(
        all_nodes.join(stored(children, "children"), node, "left").select(
            *node, "pa", "pb", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), own_value.alias("value")
        ),
        "valued-nodes",
    )
    # Of each conversation: what the nodes it owns save, and the leaf it owns.
    owned = stored(
        valued.groupBy("conv_id").agg(F.sum("value").alias("saves"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves")),
        "owned",
    )
    amounts = blocks.join(owned, "conv_id", "left").withColumns(
        {"saves": F.coalesce("saves", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(0))}
    )
    totals = _named(_roll_up(amounts, "sum(saves) AS saves, sum(leaves) AS n_leaves", width), width)
    all_owned = owned.agg(F.sum("saves").alias("saves"), F.sum("leaves").alias("n_leaves")).where("saves IS NOT NULL")
    totals = totals.select(*node, "saves", "n_leaves").unionByName(
        all_owned.select(*(F.lit(0).cast("long").alias(c) for c in node), "saves", "n_leaves")
    )

    # What the owner's nodes above a node save: running totals along the owner's path, in spans.
    spanned = valued.withColumn("span", F.floor(F.col("depth") / SPAN))
    spans = spanned.groupBy("conv_id", "span").agg(F.sum("value").alias("of_span"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    above_span = spans.withColumn("of_span", F.sum("of_span").over(earlier)).where("of_span > 0")
    in_span = Window.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = spanned.withColumn("above", F.sum("value").over(in_span)).join(above_span, ["conv_id", "span"], "left")
    above = F.coalesce("above", F.lit(0)) + F.coalesce("of_span", F.lit(0))

    depths = turns.groupBy("conv_id").agg(
        F.max("pos").alias("depth"), *(F.bit_xor(_path(s, F.col("pos"), F.col("id"))).alias(c) for s, c in ((1, "a"), (2, "b")))
    )
    turnless = conversations.where("n = 0").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in node))
    ends = _id_hashes(stored(depths.unionByName(turnless), "ends"))

    parents = all_nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    return (
        placed.withColumn("above", above)
        .join(stored(totals, "totals"), node)
        .join(stored(ends, "end-hashes"), node, "left")
        .join(parents, ["depth", "pa", "pb"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            F.col("n_leaves").cast("long").alias("n_leaves"),
            (F.col("saves") - F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def conversation_trie(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", width: int = BLOCK_TURNS
) -> DataFrame:
    """The trie of the prefixes of all rebuilt conversations of ``df``; see ``rebuild`` and ``prefix_trie``.

    A turn is its role and text, null ones being empty. Turns are ordered by ``turn``, null
    first, and equal ones by a digest of role and text; a repeated row is a turn of its own.
    Rows without a conversation id belong to none. Turns of one role and text are told from
    others by 128 bits of a hash, and so are paths. Other columns are not looked at. An
    empty table has no nodes, not even a root.
    """
    turns, conversations = rebuild(stored(numbered(turn_ids(df, conv, turn, role, text)), "numbered"))
    return prefix_trie(stored(turns, "rebuilt"), stored(conversations, "lengths"), width)


# The plain way: every prefix of every conversation as a list, and every node's ancestors.
SQL = """
WITH RECURSIVE turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), crcs AS (
    SELECT i AS n, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v
    FROM range(256) t(i)
), bytes AS (
    SELECT conv_id, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))) AS b
    FROM (SELECT DISTINCT conv_id FROM turns)
), steps AS (
    SELECT conv_id, b, 0 AS done, 4294967295::BIGINT AS c FROM bytes
    UNION ALL
    SELECT conv_id, b, done + 1, xor(crcs.v::BIGINT, c // 256)
    FROM steps JOIN crcs ON crcs.n = xor(c % 256, b[done + 1]::BIGINT) WHERE done < len(b)
), convs AS (
    SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM steps WHERE done = len(b)
), rebuilt AS (
    SELECT c.conv_id, t.pos, t.role, t.text, 0 AS own
    FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, t.pos, t.role, t.text, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), paths AS (
    SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY own, pos) FILTER (WHERE role IS NOT NULL), []) AS p
    FROM convs c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
    SELECT conv_id, unnest(range(0, len(p) + 1)) AS depth, p FROM paths
), nodes AS (
    SELECT p[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(p) = depth), '') AS ends
    FROM prefixes GROUP BY ALL
), below AS (
    SELECT n.node, count(c.node) AS n_children FROM nodes n
    LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.node[1:n.depth] = n.node GROUP BY n.node
), valued AS (
    SELECT n.*, n_children, CASE WHEN depth = 0 THEN 0
        ELSE (n_convs - 1) * len(regexp_extract_all(node[depth].t, '[^\\x20\\x09-\\x0D]+')) END AS value
    FROM nodes n JOIN below USING (node)
), upwards AS (
    SELECT node[1:d] AS node, sum(value) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM valued) GROUP BY ALL
)
SELECT v.conv_id, v.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, v.n_convs, v.n_children,
       u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN upwards u ON u.node = v.node
LEFT JOIN nodes parent ON v.depth > 0 AND parent.depth = v.depth - 1 AND parent.node = v.node[1:v.depth - 1]
"""
