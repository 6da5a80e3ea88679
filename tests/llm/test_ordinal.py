"""Gradients, and what the grades tell of held-out documents."""

import zlib

import numpy as np

from spendgrain.llm import ordinal
from spendgrain.llm.common import table

FOLDER = "/root/testdata/sf0.1"


def test_features_do_not_depend_on_neighbours():
    texts = [b"One two, THREE!! 4", b"", b" \n", "é É one".encode(), b"x" * 300000]
    offsets = np.cumsum([0, *map(len, texts)])
    own, at = ordinal.features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for k, t in enumerate(texts):
        alone, _ = ordinal.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert own[at[k] : at[k + 1]].tolist() == alone.tolist()


def test_ordered_thresholds_and_a_known_trend():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 600)
    buckets = np.stack([grades + 10, rng.integers(100, 200, 600)], 1).ravel()
    model = ordinal.train(buckets, np.arange(0, 1201, 2), grades, 4)
    assert (np.diff(model.thresholds) > 0).all() and model.grades == 4
    tails = model.tails(ordinal._scores(model.weights, buckets, np.arange(0, 1201, 2)))
    assert (np.diff(tails, axis=1) < 0).all()
    assert np.corrcoef(tails.sum(1), grades)[0, 1] > 0.95


def test_held_out_grades(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    ratings = ordinal.rated(labels)
    model = ordinal.fit(docs, ratings)
    found = {r.doc_id: r for r in ordinal.grade(docs, model).collect()}
    assert len(found) == docs.count()
    test = [r for r in ratings.collect() if zlib.crc32(str(r.rated_id).encode()) % 4 == 2]
    for grade, least in ((0, 0.9), (1, 0.9), (2, 0.97)):
        own = [found[r.rated_id].kept == (grade == 2) for r in test if r.grade == grade]
        assert sum(own) / len(own) >= least, (grade, sum(own), len(own))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 2), (2, "", 3)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    assert {(r.rated_id, r.grade) for r in ordinal.rated(labels).collect()} == {(1, 1), (2, 0)}
    found = ordinal.grade(docs, ordinal.fit(docs.limit(0), ordinal.rated(labels))).collect()
    assert len(found) == 4 and all(r.kept and r.tail_prob is None for r in found)
    model = ordinal.OrdinalModel(np.zeros(ordinal.BUCKETS), np.array([-1.0, 1.0]))
    assert len(ordinal.grade(docs, model).collect()) == 4
    assert ordinal.grade(docs.limit(0), model).count() == 0
