"""Token ids in files of directly addressable codes."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import column
from .common import in_arrow, stored
from .segments import SegmentCache

CHUNK_BITS = 8
RANK_BITS = 512  # bits between two entries of a rank directory
SEGMENT_TOKENS = 1 << 20
END_ID = 0
# Segments that are encoded as one line, since each begins with a space before a character
# that is no white space and ends with one, too.
SEGMENTS_JOINED = 1000
_JOINS = re.compile(r" [^\s](?:[^ ]*[^\s])?\Z")
SPACE_TOKEN = "Ġ"  # fixed: how the vocabulary writes a space


class Codes:
    """Ids split into chunks of 8 bits, one array of chunks a level.

    A bit beside each chunk says whether its id goes on in the next level; the number of
    such bits before it is its place there. A directory of these numbers, one for every
    512 chunks, makes any id readable in a few steps, without decoding what is before it.

    Bytes: number of levels (4), then for each level its number of chunks (8), the
    directory (8 each), the bits (little-endian, padded to bytes) and the chunks.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels  # directory, bits as bytes, chunks

    @classmethod
    def pack(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint32)
        while len(rest) or not levels:
            more = rest >> np.uint32(CHUNK_BITS)
            goes_on = more > 0
            counts = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.int64) if len(rest) else []
            directory = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
            levels.append((directory, np.packbits(goes_on, bitorder="little"), rest.astype(np.uint8)))
            rest = more[goes_on]
        return cls(levels)

    def to_bytes(self) -> bytes:
        out = [np.array(len(self.levels), "<u4").tobytes()]
        for directory, bits, chunks in self.levels:
            out += [np.array(len(chunks), "<u8").tobytes(), directory.tobytes(), bits.tobytes(), chunks.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Codes:
        levels, at = [], 4
        for _ in range(int(np.frombuffer(data, "<u4", 1)[0])):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            blocks, n_bytes = -(-n // RANK_BITS) + 1, -(-n // 8)
            at += 8
            directory = np.frombuffer(data, "<i8", blocks, at)
            at += 8 * blocks
            bits = np.frombuffer(data, np.uint8, n_bytes, at)
            at += n_bytes
            levels.append((directory, bits, np.frombuffer(data, np.uint8, n, at)))
            at += n
        return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][2])

    @staticmethod
    def _rank(directory: np.ndarray, bits: np.ndarray, at: int) -> int:
        """Continuation bits before place ``at``."""
        block = at // RANK_BITS
        first, whole = block * RANK_BITS // 8, at // 8
        count = int(directory[block]) + int(np.bitwise_count(bits[first:whole]).sum())
        return count + (int(bits[whole]) & ((1 << at % 8) - 1)).bit_count() if at % 8 else count

    def __getitem__(self, at: int) -> int:
        value = shift = 0
        for directory, bits, chunks in self.levels:
            value |= int(chunks[at]) << shift
            if not bits[at // 8] >> (at % 8) & 1:
                break
            at, shift = self._rank(directory, bits, at), shift + CHUNK_BITS
        return value

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` as unsigned 32-bit integers."""
        values = np.zeros(end - start, "<u4")
        places = np.arange(end - start)
        for shift, (directory, bits, chunks) in enumerate(self.levels):
            if start >= end:
                break
            values[places] |= chunks[start:end].astype("<u4") << np.uint32(CHUNK_BITS * shift)
            first = start // 8
            goes_on = np.unpackbits(bits[first : -(-end // 8)], bitorder="little")[start - 8 * first : end - 8 * first]
            places = places[goes_on.astype(bool)]
            start, end = self._rank(directory, bits, start), self._rank(directory, bits, end)
        return values


_tokenizers: dict[str, SegmentCache] = {}  # of this worker


def _cache(definition: str) -> SegmentCache:
    if definition not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.encode_special_tokens = True

        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        opens[[i for token, i in vocabulary.items() if token.startswith(SPACE_TOKEN)]] = True

        def one_by_one(segments: list[str]) -> list[bytes]:
            found = tokenizer.encode_batch_fast(segments, add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in found]

        def encode(segments: list[str]) -> list[bytes]:
            out: list[bytes] = [b""] * len(segments)
            lone = [i for i, s in enumerate(segments) if not _JOINS.match(s)]
            joined = sorted(set(range(len(segments))) - set(lone))
            for i, ids in zip(lone, one_by_one([segments[i] for i in lone]), strict=True):
                out[i] = ids
            lines = [joined[at : at + SEGMENTS_JOINED] for at in range(0, len(joined), SEGMENTS_JOINED)]
            for line, ids in zip(lines, one_by_one(["".join([segments[i] for i in line]) for line in lines]), strict=True):
                # Each segment's first token, and no other, begins with a space.
                starts = np.flatnonzero(opens[np.frombuffer(ids, "<u4")])
                if len(starts) != len(line) or starts[0]:
                    parts = one_by_one([segments[i] for i in line])
                else:
                    edges = [*(4 * starts).tolist(), len(ids)]
                    parts = [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]
                for i, part in zip(line, parts, strict=True):
                    out[i] = part
            return out

        _tokenizers.clear()
        _tokenizers[definition] = SegmentCache(encode)
    return _tokenizers[definition]


SEGMENT_SCHEMA = "part int, segment int, start_in_part long, n_tokens long, doc_ids array<long>, lengths array<long>, codes binary"


def write_tokens(df: DataFrame, tokenizer_path: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The token files: rows of about a million ids, in ascending order of the documents.

    (part, segment, start_in_part, n_tokens, doc_ids, lengths, codes). ``part`` counts up
    with the document ids, ``segment`` within a part. A document is never split over
    segments, so one that is longer makes a longer segment. Null texts are empty ones,
    documents without an id come first, and equal ids are in the order of their texts.
    Each document ends with ``END_ID``. Special tokens in a text are ordinary text.
    """
    with open(tokenizer_path) as file:  # of fixed size
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = _cache(shared.value), TaskContext.get().partitionId()
        end, segment, start = np.array([END_ID], "<u4").tobytes(), 0, 0
        docs, pieces, held = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pieces), "<u4")
            values = [part, segment, start, len(ids), docs, [len(p) // 4 for p in pieces], Codes.pack(ids).to_bytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        names = ["part", "segment", "start_in_part", "n_tokens", "doc_ids", "lengths", "codes"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 2500):
                rows = batch.slice(at, 2500)
                encoded = cache.encode([t or "" for t in rows.column("text").to_pylist()])
                for key, ids in zip(rows.column("doc_id").to_pylist(), encoded, strict=True):
                    docs.append(key)
                    pieces.append(ids + end)
                    held += len(pieces[-1]) // 4
                    if held >= SEGMENT_TOKENS:
                        yield flush()
                        segment, start = segment + 1, start + held
                        docs, pieces, held = [], [], 0
        if docs:
            yield flush()

    rows = df.select(column(doc).cast("long").alias("doc_id"), column(text).alias("text"))
    # By the beginnings of texts too, so that many rows of one id, or without, are dealt out.
    in_order = rows.repartitionByRange("doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")
    return stored(in_arrow(in_order, run, SEGMENT_SCHEMA), "token-files")


def read_tokens(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document, read from the token files.

    ``start`` is the number of ids of all documents before it. Without ``with_ids``, ``ids``
    is null: they are read for the checksum, but not handed on.
    """
    # One row a part, of which there are as many as partitions at most.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum([0, *row["lengths"]]).tolist()
                # All documents of the segment are wanted, so its ids are read as one slice.
                ids = memoryview(Codes.from_bytes(row["codes"]).slice(0, ends[-1]).tobytes())
                texts = [ids[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([row["start"] + a for a in ends[:-1]], pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                        pa.array([bytes(t) if with_ids else None for t in texts], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    placed = files.join(F.broadcast(bases), "part").select(
        "doc_ids", "lengths", "codes", (F.col("base") + F.col("start_in_part")).alias("start")
    )
    return in_arrow(placed, run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
