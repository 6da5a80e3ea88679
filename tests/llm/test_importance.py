"""Buckets against zlib, bit planes against a plain product, and the whole draw against a loop."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spendgrain.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def buckets(text):
    return Counter(zlib.crc32(f.encode()) % 10000 for f in features(text)[1])


def brute(rows, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, text in rows:
        s += buckets(text)
    for text in target:
        t += buckets(text)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        words, own = features(text)
        weight = sum(n * gain[b] for b, n in buckets(text).items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(own), weight, score, len(words) >= least])
    usable = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2]))
    rank = {id(r): k for k, r in enumerate(usable[: len(usable) * percent // 100], 1)}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=str)


TEXT = st.text(alphabet=st.sampled_from("abzAZ09 .-_é中\u0080\n"), max_size=80)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12), st.sampled_from([1, 2, 3, 5, 1 << 18]))
def test_buckets(texts, block):
    old, importance.WORDS = importance.WORDS, block
    try:
        words, blocks = importance.features(pa.array(texts, pa.string()))
        found = [Counter() for _ in texts]
        for owners, own in blocks:
            assert (np.diff(owners) >= 0).all()
            for o, b in zip(owners.tolist(), own.tolist(), strict=True):
                found[o][b] += 1
    finally:
        importance.WORDS = old
    assert found == [buckets(t) for t in texts]
    assert words.tolist() == [len(features(t)[0]) for t in texts]


@pytest.mark.parametrize("length", [1, 63, 64, 65, 66, 1000, 70_001])
def test_long_words(length):
    text = f"a {'b' * length} c {'é' * length} {'d' * length}"
    _, blocks = importance.features(pa.array([text]))
    assert Counter(np.concatenate([b for _, b in blocks]).tolist()) == buckets(text)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 2**20), st.integers(1, 20_000))
def test_planes_are_exact(seed, most, reach):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, most, (5, importance.BUCKETS)) * (rng.random((5, importance.BUCKETS)) < 0.05)
    counts[2] = 0
    gain = rng.integers(-reach, reach, importance.BUCKETS)
    assert (importance.bit_sliced(counts, importance.gain_planes(gain)) == counts @ gain).all()


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(5, 60)))) for i in range(500)]
    rows += [(i, rows[0][1]) for i in range(500, 900)]
    rows += [(1000, None), (1001, ""), (1002, "..."), (None, rows[1][1]), (None, rows[1][1]), (7, rows[2][1]), (7, rows[7][1]), (1003, "w1 " * 60_000)]
    return rows, [" ".join(words[:40]), None, "", " ".join(words[10:30])]


@pytest.mark.parametrize("percent", [0, 5, 60, 100])
def test_draw(spark, percent):
    rows, target = corpus()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row int, part string, bin int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = importance.resample(docs, wanted, percent=percent)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, target, percent)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert sorted(map(tuple, importance.resample(some, none, least_words=0).collect())) == brute([(1, "a b c"), (2, None)], [], least=0)


def test_equal_scores_go_by_id(spark):
    rows = [(i, 10, 5, 100, True) for i in (5, 3, 9, 1, 7)] + [(None, 10, 5, 100, True), (0, 10, 5, 99, True), (2, 1, 5, 500, False)]
    found = importance.draw(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, eligible boolean"), 100)
    assert {r["doc_id"]: r["rank"] for r in found.collect()} == {1: 1, 3: 2, 5: 3, 7: 4, 9: 5, None: 6, 0: 7, 2: None}
