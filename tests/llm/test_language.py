"""Gradients against differences, and accuracy on documents that are not learned from."""

import zlib

import numpy as np

from spendgrain.llm import gru, language
from spendgrain.llm.common import table

FOLDER = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = [rng.normal(0, 0.5, s).astype(np.float32) for s in ((2, 6, 257), (2, 6, 2), (2, 3, 2), (3,))]
    windows = rng.integers(0, 5, (7, 4))
    windows[5:, 1] = gru.FILL
    labels = np.array([0, 1, 2, 1])
    _, gradients = gru._loss_and_gradients(w, windows, labels)
    for x, g in zip(w, gradients, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = x[at], 1e-2
        x[at] = old + step
        up, _ = gru._loss_and_gradients(w, windows, labels)
        x[at] = old - step
        down, _ = gru._loss_and_gradients(w, windows, labels)
        x[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.02 * abs(g[at]) + 1e-3


def test_training_and_prediction_see_the_same_network():
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 105, (40, 16))
    net = gru.train(windows, np.arange(40) % 2, 2, rounds=2, batch=8)
    p = gru.position_probabilities(net, np.ascontiguousarray(windows.T))
    _, gradients = gru._loss_and_gradients([net.table, net.gates, net.head, net.bias], windows.T, np.zeros(40, int))
    wanted = p.mean((0, 2)) - np.array([1, 0])
    assert np.abs(gradients[3] - wanted).max() < 1e-4


def test_accuracy_on_held_out_documents(spark):
    docs = table(spark, FOLDER, "documents")
    model = language.fit(docs)
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(found) == len(rows)
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum(found[r.doc_id].lang_pred == r.lang for r in test) / len(test)
    assert right > 0.97, right
    assert all(0 <= r.score <= 1 for r in found.values())
    again = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert again == found


def test_odd_rows(spark):
    rows = [(1, "der die das und", "de", 1.5), (2, None, None, None), (3, "123 !?", "de", 0.0), (None, "the and of", "en", 1.0), (4, "the " * 40000, None, 2.0), (5, "", "en", 0.0)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, lang string, named double")
    sample = docs.where("doc_id in (1, 4)").unionByName(spark.createDataFrame([(7, "the of and to", "en", 0.0), (8, "der die das", "de", 0.0)], docs.schema))
    model = language.fit(sample, rounds=60)
    found = language.identify(docs, model, positions=True).collect()
    assert len(found) == 7
    by = {r.doc_id: r for r in found}
    assert all((by[i].lang_pred, by[i].score, by[i].runs) == ("und", 0.0, []) for i in (2, 3, 5))
    assert by[4].runs[0].start == 0 and by[4].runs[-1].end == 160000
    assert by[4].lang_pred in model.languages and 0 < by[4].score <= 1
    kept = language.recognised(docs, rounds=5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} <= {1, 4, None}
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}


def test_documents_stay_where_no_language_is_known(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows = [(held, "der die das", "de"), (100, "the of and", None), (None, "no id", "en"), (101, "123", None), (102, None, None), (103, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = language.recognised(docs).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(rows[:3], key=str)


def test_least_score_follows_the_number_of_languages():
    assert language.least_score(1) == 0 and abs(language.least_score(4) - 0.3) < 1e-12
    for n in (2, 3, 4, 50, 1000):
        assert 1 / n < language.least_score(n) < 1 / n + 1 / 15


def test_documents_below_the_least_score_go_and_no_others(spark):
    rows = [(i, ("der die das und " if i % 2 else "the and of to ") * 5, "de" if i % 2 else "en") for i in range(40)]
    rows += [(100 + i, text, None) for i, text in enumerate(["der the die and das of und to", "zqxj", "a", "123"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for above in (1 / 15, 0.9):
        scores = {r.doc_id: r.score for r in language.identify(docs, language.fit(docs, rounds=40)).collect()}
        wanted = {i for i, x in scores.items() if x >= language.least_score(2, above)}
        assert {r.doc_id for r in language.recognised(docs, above_chance=above, rounds=40).collect()} == wanted
    assert wanted < set(scores)
