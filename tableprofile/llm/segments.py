"""Independent segments of a text for tokenizers whose pieces start at single spaces."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

# A space between two characters that are no white space always begins a piece of the
# public byte-level pattern, so what stands between such spaces is encoded on its own.
_PAIR_OF_SPACES = re.compile(r"\s\s")
_CUTS = re.compile(r"(?<=\S)(?= \S)")

# Marks behind a letter are a piece of the pattern, up to the next space.
MARKS = ".,;:!?)"

# What a worker remembers: segments of at most so many characters, up to four times so many of them.
CACHE_CHARS = 64
CACHE_ENTRIES = 3 << 17  # with about 200 bytes each, and 1 KB at the very most
RUN_CHARS = 1 << 23  # characters of texts encoded at once, or one longer text


class SegmentCache:
    """Encodes texts segment by segment and remembers what each short segment gives.

    ``encode`` takes a list of strings and returns for each the bytes of its ids, four an
    id. When the cache is full, what was asked for since it was last full is kept for as
    long again. It takes no long segment (a text without spaces is one), so its memory is
    bounded in bytes and its results are always exact.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self._encode, self._entries = encode, entries
        # By what stands before a segment: nothing, or the space it was cut at.
        self._known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self._before: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    def _ids(self, segments: list[str], prefix: str) -> list[bytes]:
        """What each of the different ``segments`` gives behind ``prefix``."""
        known, before = self._known[prefix], self._before[prefix]
        found = list(map(known.get, segments))
        absent = [i for i, ids in enumerate(found) if ids is None]
        unseen = []
        for i, ids in zip(absent, map(before.get, [segments[i] for i in absent]), strict=True):
            found[i] = ids
            if ids is None:
                unseen.append(i)
        learnt = self._learn([segments[i] for i in unseen], prefix) if unseen else []
        for i, ids in zip(unseen, learnt, strict=True):
            found[i] = ids
        new = {segments[i]: found[i] for i in absent if len(segments[i]) <= CACHE_CHARS}
        if len(known) + len(new) > self._entries:
            self._before[prefix], self._known[prefix] = known, {}
        self._known[prefix].update(new)
        return found

    def _learn(self, unseen: list[str], prefix: str) -> list[bytes]:
        """What segments without an entry give: most of those that end in marks have one without them."""
        known, before = self._known[prefix], self._before[prefix]
        stems, marks = [], []
        for segment in unseen:
            stem = segment.rstrip(MARKS)
            stem = stem if stem[-1:].isalpha() else segment
            stems.append(stem)
            marks.append(segment[len(stem) :])
        ids = {s: known.get(s) or before.get(s) for s in stems}
        new = [s for s, x in ids.items() if x is None]
        ids.update(zip(new, self._encode([prefix + s for s in new]), strict=True))
        ends = sorted(set(marks) - {""})
        of_marks = {"": b"", **dict(zip(ends, self._encode(ends) if ends else (), strict=True))}
        return [ids[s] + of_marks[m] for s, m in zip(stems, marks, strict=True)]

    def _joined(self, segments: pa.Array, ends: np.ndarray, prefix: str = "") -> list[bytes]:
        """The ids of the segments up to each end, in one piece. Different segments are looked up once."""
        coded = segments.dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist(), prefix)
        flat = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = np.cumsum(lengths) - lengths
        places = coded.indices.to_numpy(zero_copy_only=False)
        counts = lengths[places]
        up_to = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(begins[places] - up_to[:-1], counts)
        at += np.arange(len(at))
        all_ids = flat[at].tobytes()
        edges = (up_to[np.concatenate([[0], ends])] * 4).tolist()
        return [all_ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The encoded form of each text."""
        return [ids for a, b in slices(texts, RUN_CHARS) for ids in self._encode_run(texts[a:b])]

    def _encode_run(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        spread = [i for i, text in enumerate(texts) if _PAIR_OF_SPACES.search(text)]
        plain = sorted(set(range(len(texts))) - set(spread))
        if plain:
            # All but the first segment of a text get the space back that was before them.
            words = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
            begins, flat = words.offsets.to_numpy()[:-1], words.flatten()
            is_first = np.zeros(len(flat), bool)
            is_first[begins] = True
            upto = np.arange(1, len(plain) + 1)
            firsts = self._joined(flat.filter(pa.array(is_first)), upto)
            ends = np.append(begins[1:], len(flat)) - upto
            behind = self._joined(flat.filter(pa.array(~is_first)), ends, " ")
            for i, first, more in zip(plain, firsts, behind, strict=True):
                out[i] = first + more
        if spread:
            cut = [_CUTS.split(texts[i]) for i in spread]
            ends = np.cumsum([len(c) for c in cut])
            for i, ids in zip(spread, self._joined(pa.array([s for c in cut for s in c], pa.string()), ends), strict=True):
                out[i] = ids
        return out
