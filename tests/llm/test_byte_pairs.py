"""Byte-level BPE."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprofile.llm import byte_pairs

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
RANKS = byte_pairs.read_ranks(public.path("byte_bpe_50k.tiktoken"))
PAIRS = byte_pairs.BytePairs(RANKS)
ENCODER = byte_pairs.TextEncoder(RANKS, public.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = st.text(st.sampled_from("abcet 'sé日🙂\n\t1.\x1c\x85 "), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_the_library(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == LIBRARY.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text("etaoinsh", max_size=300), st.integers(0, 300), st.integers(0, 6), st.text("etao", max_size=5))
def test_appends_and_edits_give_the_table_of_the_new_piece(text, start, length, new):
    piece = text.encode()
    last = PAIRS.last_tokens(piece)
    assert PAIRS.last_tokens(piece + new.encode(), last) == PAIRS.last_tokens(piece + new.encode())
    start = min(start, len(piece))
    end = min(len(piece), start + length)
    changed, table = PAIRS.edited(piece, last, start, end, new.encode())
    assert changed == piece[:start] + new.encode() + piece[end:]
    assert table == PAIRS.last_tokens(changed)


def test_the_memory_can_be_emptied():
    small = byte_pairs.SegmentCache(lambda s: [ENCODER.encode_segment(x) for x in s], entries=3)
    texts = ["the cat sat on the mat", "a b c d e f", "", "the cat  sat"]
    assert small.encode(texts) == ENCODER.encode(texts) == small.encode(texts)


def test_texts_without_spaces_are_not_remembered():
    small = byte_pairs.SegmentCache(lambda s: [x.encode()[: len(x.encode()) // 4 * 4] for x in s], entries=10)
    for i in range(200):
        text = "日本" * 5000 + f"{i} word{i}, two word{i % 3}. {'x' * 65}"
        whole, *spaced = text.split(" ")
        want = [s.encode()[: len(s.encode()) // 4 * 4] for s in (whole, *(" " + s for s in spaced))]
        assert len(small.encode([text])[0]) >= len(want[0])
    held = [*small._known.values(), *small._before.values()]
    assert all(len(segment) <= 64 for part in held for segment in part) and all(len(part) <= 10 for part in held)


def test_every_row_is_encoded_and_decoded(spark):
    rows = [(1, "Hello world", 1), (1, "Hello world", 1), (2, None, 2), (3, "", 3), (None, "x " * 50_000, 4), (4, "日本", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = byte_pairs.encode_and_decode(df, public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()
    want = []
    for doc, text, _ in rows:
        ids = np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()
        want.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((*r[:4], bytes(r[4])) for r in got), key=key) == sorted(want, key=key)
    assert byte_pairs.encode_and_decode(df.limit(0), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0
