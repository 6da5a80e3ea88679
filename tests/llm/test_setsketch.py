"""Near duplicates against all pairs compared directly."""

import re
from itertools import combinations

import numpy as np
import pytest

from spendgrain.llm import setsketch
from spendgrain.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} - {()}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = np.random.default_rng(3)
    word = [f"W{i}é" for i in range(400)]
    texts = [None, "", " \t\n", "one", "ONE", "two words", "a b c d", "A  b\nc d", "a b c d e"]
    for size in (30, 60, 200, 3000):
        base = list(rng.choice(word, size))
        for change in (0, 1, 2, 3, 5, 8):
            for _ in range(3):
                own = list(base)
                for i in rng.choice(size, min(change, size), replace=False):
                    own[i] = "x" + str(rng.integers(10**9))
                texts.append(" ".join(own))
    passage = " ".join(rng.choice(word, 60))
    texts += [passage + " " + " ".join(rng.choice(word, 20)) for _ in range(30)]
    return list(enumerate(texts))


@pytest.mark.parametrize(("percent", "turns"), [(80, 0), (85, 2)])
def test_same_components_as_all_pairs(spark, percent, turns):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, root string, bucket int")
    found = setsketch.near_duplicates(docs, percent, star_turns=turns).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_a_group_larger_than_a_tile(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "_TILE", 4)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = setsketch.near_duplicates(docs, 80, star_turns=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 80)


def test_empty_table_null_and_repeated_ids(spark):
    assert setsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (3, long), (3, long), (2, "other"), (2, long), (None, "alone")]
    found = setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found)
    assert got == sorted(
        [("None", 46, "2", False), ("3", 46, "2", False), ("3", 46, "2", False), ("2", 1, "2", True), ("2", 46, "2", True), ("None", 1, "None", True)]
    )


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**63, (2, 4000), dtype=np.uint64)
    a, b = np.concatenate([x, y[:2000]]), np.concatenate([x, y[2000:]])
    at = np.array([0, len(a)])
    first, second = (setsketch.registers(setsketch.minima(s, at)) for s in (a, b))
    union = setsketch.registers(setsketch.minima(np.concatenate([a, b]), np.array([0, 12000])))
    assert (setsketch.merged(first, second) == union).all()
    guess, _ = setsketch.likely(first, second, np.array([6000]), np.array([6000]), 0.8)
    assert abs(guess[0] - 0.5) < 0.2


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 7), (61, 60)]
    found = connected_components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(62)} | {1000 + i: 1000 for i in range(200)}


def test_kept_documents_keep_columns_and_one_copy(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long, 0), (1, long, 1), (2, long + " end", 2), (3, None, 3), (3, None, 4), (None, "clean text", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    kept = setsketch.kept_documents(docs, setsketch.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 3]


def test_one_text_of_a_group_stays_under_one_id_and_under_null(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[k:]) for k in range(3)]
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(7, near[0]), (7, near[1]), (9, near[2]), (7, "alone"), (None, other), (None, other + " a"), (None, other + " b"), (None, other), (None, "one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = setsketch.kept_documents(docs, setsketch.near_duplicates(docs)).collect()
    texts = sorted(r.text for r in kept if r.text)
    assert len(kept) == 5 and sum(r.doc_id == 7 for r in kept) == 2
    assert sum(t in near[:2] for t in texts) == 1 and sum(t.startswith("v0") for t in texts) == 1 and {"alone", "one"} <= set(texts)
