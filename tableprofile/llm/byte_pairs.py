"""Byte-level BPE by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import column
from .common import in_arrow
from .segments import SegmentCache

# Prefixes up to this many bytes are remembered across pieces.
SHARED_PREFIX_BYTES = 24
MEMO_ENTRIES = 1 << 19
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairs:
    """Encodes pieces of bytes by a table of ranks.

    The encoding of every prefix of a piece is a prefix's encoding plus one last token, and
    that last token is unique. ``last_tokens`` fills this table from left to right: a token
    that ends here is the last one exactly if it may follow the last token of what stands
    before it. Two tokens may be neighbours exactly if no merge across their border comes
    first while the two are built up from bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._left: dict[int, list[int]] = {}  # first byte, ..., the token: what begins it as it is built up
        self._right: dict[int, list[int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            parts = [token] if len(token) == 1 else self._merged(token, rank)
            if len(parts) == 1:
                self._left[rank] = self._right[rank] = [rank]
            elif len(parts) == 2:  # others cannot come about by merges
                left, right = (ranks[part] for part in parts)
                if left in self._left and right in self._right:
                    self._left[rank] = [*self._left[left], rank]
                    self._right[rank] = [*self._right[right], rank]
        self._reached = {self.tokens[rank]: rank for rank in self._left}
        self._longest = max(map(len, self._reached))
        self._may_follow: dict[tuple[int, int], bool] = {}
        self._prefixes: dict[bytes, int] = {}

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """The parts of ``token`` after all merges of lower rank than ``below``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(found)
            if best >= below:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of ``a`` and ``b`` is these two tokens."""
        known = self._may_follow.get((a, b))
        if known is None:
            if len(self._may_follow) >= MEMO_ENTRIES:
                self._may_follow.clear()
            known = self._may_follow[a, b] = self._border_holds(self._right[a], self._left[b])
        return known

    def _border_holds(self, ends: list[int], begins: list[int]) -> bool:
        i = j = 0
        while True:
            next_end = ends[i + 1] if i + 1 < len(ends) else _NEVER
            next_begin = begins[j + 1] if j + 1 < len(begins) else _NEVER
            across = self.ranks.get(self.tokens[ends[i]] + self.tokens[begins[j]], _NEVER)
            # Of equal merges the leftmost comes first: left of the border, across, right.
            if across < next_end and across <= next_begin and across != _NEVER:
                return False
            if next_end == next_begin == _NEVER:
                return True
            if next_end <= next_begin:
                i += 1
            else:
                j += 1

    def _last_token(self, piece: bytes, last: list[int], end: int) -> int:
        for start in range(max(0, end - self._longest), end):
            token = self._reached.get(piece[start:end])
            if token is not None and (start == 0 or self.may_follow(last[start], token)):
                return token
        raise ValueError("the ranks lack a byte")

    def last_tokens(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix of ``piece``; at 0 none (-1).

        ``last`` may hold the table of a prefix of ``piece``: then only the rest is added.
        """
        last = [-1] if last is None else list(last)
        for end in range(len(last), len(piece) + 1):
            if end <= SHARED_PREFIX_BYTES:
                prefix = piece[:end]
                token = self._prefixes.get(prefix)
                if token is None:
                    token = self._last_token(piece, last, end)
                    if len(self._prefixes) >= MEMO_ENTRIES:
                        self._prefixes.clear()
                    self._prefixes[prefix] = token
            else:
                token = self._last_token(piece, last, end)
            last.append(token)
        return last

    def edited(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """``piece`` and its table after ``piece[start:end]`` became ``new``.

        The table up to ``start`` stays. Behind the new bytes it is filled again only until
        it agrees with the old one over the length of the longest token: from there on the
        old entries hold.
        """
        changed = piece[:start] + new + piece[end:]
        table, agreed, shift = list(last[: start + 1]), 0, len(new) - (end - start)
        for at in range(start + 1, len(changed) + 1):
            token = self._last_token(changed, table, at)
            table.append(token)
            old = at - shift
            # Entries whose longest token reaches over the edit may agree by chance only.
            agreed = agreed + 1 if old > end and last[old] == token else 0
            if agreed >= self._longest:
                table += last[old + 1 :]
                break
        return changed, table

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.read_back(self.last_tokens(piece))

    def read_back(self, last: list[int]) -> list[int]:
        """The tokens of the whole piece, from its table."""
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.tokens[last[end]])
        return ids[::-1]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class TextEncoder:
    """Texts to little-endian 32-bit ids, each match of ``pattern`` encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pairs = BytePairs(ranks)
        self._pieces = regex.compile(pattern)
        self._cache = SegmentCache(lambda segments: [self.encode_segment(s) for s in segments])

    def encode_segment(self, segment: str) -> bytes:
        ids = []
        for piece in self._pieces.findall(segment):
            ids += self.pairs.encode_piece(piece.encode())
        return np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._cache.encode(texts)


_encoders: dict[tuple[str, str], TextEncoder] = {}  # of this worker


def _encoder(ranks: dict[bytes, int], key: tuple[str, str]) -> TextEncoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(ranks, key[1])
    return _encoders[key]


def encode_and_decode(df: DataFrame, ranks_path: str, pattern: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): every whole text to ids and back.

    A null or empty text has no ids. Rows stay as they are, repeated ones too; a null id
    stays null; other columns are not looked at. The rank table, of fixed size, is read by
    the driver from ``ranks_path`` and broadcast. ``ids`` is a binary of little-endian
    32-bit integers.
    """
    ranks = read_ranks(ranks_path)
    key = (hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest(), pattern)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, key)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                decoded = (encoder.pairs.decode(np.frombuffer(ids, "<u4")) for ids in encoded)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(ids) // 4 for ids in encoded], pa.int64()),
                        pa.array([hashlib.sha256(ids).hexdigest() for ids in encoded], pa.string()),
                        pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                        pa.array(encoded, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"],
                )

    rows = df.select(column(doc).cast("long").alias("doc_id"), column(text).alias("text"))
    return in_arrow(
        rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
    ).withColumn("ids", F.coalesce("ids", F.lit(b"")))
