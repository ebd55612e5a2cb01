"""The conversation trie against dictionaries of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import compare
import pytest

from tableprofile.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, block string, words string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append((c, len(path) == d))
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own_members) - 1) * words
    smallest = {n: min(m)[0] for n, m in members.items()}
    return sorted(
        (
            smallest[n],
            len(n),
            smallest[n[:-1]] if n else -(10**9),
            len(m),
            children[n],
            leaves[n],
            saved[n],
            hashlib.sha256(",".join(str(c) for c, last in sorted(m) if last).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    columns = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256".split(", ")
    got = prefix_trie.conversation_trie(df, **sizes).select(*columns).collect()
    return sorted(tuple(-(10**9) if v is None else v for v in r) for r in got)


def many(seed):
    random.seed(seed)
    rows = []
    for c in random.sample(range(-45, 200), 120):
        start = random.choice(["a b", "a b", "c"])
        for t in range(random.choice([1, 2, 3, 5, 9, 30])):
            role = random.choice(["u", None, ""])
            rows.append((c, t, role, start if t < 3 else random.choice(["d  e\tf", "d", None, "é g"])))
    rows += [(c, t, "u", "same") for c in (300, 301, 302, 340) for t in range(20)]
    rows += [(7, None, "u", "first"), (7, None, "v", "first"), (8, 5, "u", "tie"), (8, 5, "u", "tie"), (None, 1, "u", "lost")]
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
def test_long_short_copied_and_odd_conversations(spark, width):
    rows = many(width)
    assert found(spark, rows, width=width) == brute(rows)


def test_running_totals_go_over_spans_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    rows = many(4)
    assert found(spark, rows, width=2) == brute(rows)
    ends = spark.createDataFrame([(1, 1, 1, i) for i in range(50)] + [(2, 1, 1, 7)], "depth long, a long, b long, conv_id long")
    got = {r.depth: r.ends_sha256 for r in prefix_trie._id_hashes(ends, chunk_ids=4).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(50))).encode()).hexdigest(), 2: hashlib.sha256(b"7").hexdigest()}


def test_conversations_without_turns_and_no_rows(spark):
    assert found(spark, []) == []
    lone = [(c, 0, "u", "x") for c in (21, 22, 23, 24, 25, 26)]  # without their base, h turns are lost
    assert found(spark, lone) == brute(lone)


def test_query_equals_checking_sql(spark, folder):
    df = queries.builders()["op13_prefix_trie"](spark, folder)
    assert compare.differences(df, compare.connect(folder), queries.oracles()["op13_prefix_trie"]) is None
