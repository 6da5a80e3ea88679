"""The trie against one built by plain dictionaries, for several numbers of ranges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from spendgrain.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, path int, part string, skeleton string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            by[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for *_, t in sorted(turns)] for c, turns in by.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in sorted(whole.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[c] for c in below[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in below[node])
    out = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in found if whole[c] == node)
        up = min(members[node[:-1]]) if node else None
        out.append((min(found), len(node), up, len(found), len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n, seed, said=("a b", "c", "", None, "d e f")):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        turns = [(t, rng.choice(["user", "bot", None]), rng.choice(said)) for t in range(rng.randrange(1, 6))]
        if c % 3 == 0:  # one conversation a third of all ids hold
            turns = [(0, "user", "hot"), (1, "bot", "same words"), (2, "user", "again"), (3, "bot", "x"), (4, "bot", "y")]
        rows += [(c, t, role, text) for t, role, text in turns]
    return rows


ODD = [
    (None, 0, "user", "no id"),
    (None, None, None, None),
    (7001, None, "user", "first"),
    (7001, 0, "user", "second"),
    (7001, 0, "user", "second"),
    (7001, 0, "bot", "tie"),
    (-5, 0, "user", "negative"),
    (-20, 0, "user", "base of negative"),
    (-20, 1, "user", "more"),
    (9_007_199_254_740_993, 3, "user", "large id"),
    (7003, 0, None, "é" * 50_000 + " long"),
]


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_equals_brute_force(spark, shards):
    rows = [(*r, 1, "x", "y") for r in conversations(150, shards) + ODD + [(8000, i, "user", f"turn {i}") for i in range(300)]]
    random.Random(1).shuffle(rows)
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), shards=shards)
    assert sorted(map(tuple, found.select(*NAMES).collect()), key=str) == brute(rows)


def test_equal_conversations_spread(spark):
    rows = [(c, t, "user", f"{t} w") for c in range(0, 4000, 20) for t in range(3)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), shards=9)
    assert sorted(map(tuple, found.select(*NAMES).collect()), key=str) == brute(rows)


def test_turnless_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(lone, 0, "user", "gone")]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema))
    ends = hashlib.sha256(str(lone).encode()).hexdigest()
    assert [tuple(r) for r in found.select(*NAMES).collect()] == [(lone, 0, None, 1, 0, 1, 0, ends)] == brute(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).columns == list(NAMES)
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "a")], schema)).count() == 0


def test_skeleton_shares_nodes():
    a, b, c = (bytes([x]) * 16 for x in (1, 2, 3))
    own = prefix_trie.Skeleton.of([(1, a + b), (2, a + b + c), (4, a), (5, b"")])
    assert own.borders == {1: [0, 1, 2], 2: [0, 1, 2, 3], 4: [0, 1], 5: [0]}
    assert own.parents == [-1, 0, 1, 2] and own.depths == [0, 1, 2, 3]
