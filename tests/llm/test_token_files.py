"""Token files of directly addressable codes."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tableprofile.llm import token_files
from tableprofile.llm.token_files import Codes

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 50256, 65535, 65536, 1 << 24, (1 << 32) - 1]), max_size=1500), st.data())
def test_any_place_can_be_read(ids, data):
    codes = Codes.from_bytes(Codes.pack(np.array(ids, np.uint32)).to_bytes())
    assert len(codes) == len(ids)
    start = data.draw(st.integers(0, len(ids)))
    end = data.draw(st.integers(start, len(ids)))
    assert codes.slice(start, end).tolist() == ids[start:end]
    for at in range(start, min(end, start + 20)):
        assert codes[at] == ids[at]


def test_documents_come_back_in_order(spark, monkeypatch):
    rows = [(5, "five words are in here", 0), (2, None, 0), (9, "", 0), (-3, "a " * 3000, 0), (2, "again", 0), (None, "none", 0), (7, "<|endoftext|>", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    library = tokenizers.Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want, at = [], 0
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.read_tokens(token_files.write_tokens(df, PATH)).drop("ids").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    ids = {r.start: bytes(r.ids) for r in token_files.read_tokens(token_files.write_tokens(df, PATH)).collect()}
    assert {start: zlib.crc32(data) for start, data in ids.items()} == {r[1]: r[3] for r in want}
    assert token_files.read_tokens(token_files.write_tokens(df.limit(0), PATH)).count() == 0
