"""Ordinal regression against plain loops: the loss it minimises, and the figures of the query."""

import math

import numpy as np
import pytest

from spendgrain.llm import ordinal


def loss(weights, thresholds, texts, grades):
    """The mean negative log-likelihood, one text after the other."""
    total = 0.0
    for buckets, grade in zip(texts, grades, strict=True):
        score = sum(weights[b] for b in buckets) / math.sqrt(max(1, len(buckets)))
        at_most = [0.0, *(1 / (1 + math.exp(score - t)) for t in thresholds), 1.0]
        total -= math.log(max(at_most[grade + 1] - at_most[grade], 1e-9))
    return total / len(texts)


def noisy(n=500):
    """Three grades, and buckets whose presence tells of them only in part, so that the best weights are finite."""
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, n)
    texts = []
    for g in grades.tolist():
        own = {int(b) for b in rng.integers(100, 110, 3)}
        for bucket, chances in ((1, (0.2, 0.5, 0.8)), (2, (0.7, 0.5, 0.3)), (3, (0.3, 0.3, 0.6))):
            if rng.random() < chances[g]:
                own.add(bucket)
        texts.append(sorted(own))
    return texts, grades


def test_no_step_from_the_learned_model_lowers_the_loss():
    texts, grades = noisy()
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model = ordinal.train(np.concatenate(texts), at, grades, 3, rounds=1500, rate=0.02)
    best = loss(model.weights, model.thresholds, texts, grades.tolist())
    assert best < loss(np.zeros(ordinal.BUCKETS), model.thresholds, texts, grades.tolist()) - 0.05
    for k in range(2):
        for step in (-0.2, 0.2):
            moved = model.thresholds.copy()
            moved[k] += step
            assert loss(model.weights, moved, texts, grades.tolist()) > best
    for bucket in (1, 2, 3):
        for step in (-0.3, 0.3):
            moved = model.weights.copy()
            moved[bucket] += step
            assert loss(moved, model.thresholds, texts, grades.tolist()) > best


def test_evidence_by_counting():
    texts, grades = noisy(200)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    told = ordinal.evidence(np.concatenate(texts), at, grades, 3)
    for bucket in (1, 2, 3, 100, 5000):
        odds = [0.0]
        for cut in (1, 2):
            low = [bucket in t for t, g in zip(texts, grades, strict=True) if g < cut]
            high = [bucket in t for t, g in zip(texts, grades, strict=True) if g >= cut]
            odds.append(abs(math.log((sum(low) + 1) / (len(low) + 2)) - math.log((sum(high) + 1) / (len(high) + 2))))
        wanted = max(odds) ** 2 if sum(bucket in t for t in texts) >= 5 else 0
        assert told[bucket] == pytest.approx(wanted)


def test_grades_of_the_query(spark):
    rng = np.random.default_rng(4)
    model = ordinal.OrdinalModel(rng.normal(size=ordinal.BUCKETS), np.array([-0.5, 0.25, 1.0]))
    texts = ["One two, two", "", None, " \n", "é 12 é", "word " * 200_000, "x" * 1_000_000, "One two, two"]
    rows = [(None if i == 3 else i, t, "same", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, score double")
    found = ordinal.grade(docs.repartition(3), model, least=0.4).collect()
    wanted = []
    for i, text, _, _ in rows:
        data = (text or "").encode()
        buckets, _ = ordinal.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert len(set(buckets.tolist())) == len(buckets)
        score = sum(model.weights[b] for b in buckets.tolist()) / math.sqrt(max(1, len(buckets)))
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        wanted.append((str(i), sum(tails), tails[-1], tails[-1] >= 0.4))
    by_id = lambda r: (r[0], r[1])
    for got, want in zip(sorted(((str(r.doc_id), r.expected_grade, r.tail_prob, r.kept) for r in found), key=by_id), sorted(wanted, key=by_id), strict=True):
        assert got[0] == want[0] and got[3] == want[3]
        assert got[1:3] == pytest.approx(want[1:3], abs=1e-9)
