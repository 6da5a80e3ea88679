"""The stages one by one against brute force, over the smallest tables and some odd rows."""

import hashlib
import re
from collections import Counter

import pytest
import sentencepiece
from test_setsketch import brute

import __spark_entry__ as entry
import corpus_pipeline
from spendgrain.llm import mixing, secret_scan
from spendgrain.llm.common import stored, table
from spendgrain.llm.registry import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
SECRET = "The thought of the hand is that password = hunter2222 and the token: abcdefgh are in the text."


@pytest.fixture(scope="module")
def given(spark):
    docs = table(spark, FOLDER, "documents")
    odd = [(None, None, None, None, None), (10**6, None, "en", "src0", 0), (10**6 + 1, "123 !!", None, None, 6), (10**6 + 2, "", "de", "src1", 0), (10**6 + 3, SECRET, None, "src1", len(SECRET))]
    return stored(docs.unionByName(spark.createDataFrame(odd, docs.schema)), "given")


def test_stages(spark, given):
    docs, kept = given, {r.doc_id: r for r in given.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, FOLDER), name)
        rows = out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        if name == "language_id":
            wanted = {i for i, r in kept.items() if r.text and any(c.isalpha() for c in r.text)}
            assert {r.doc_id for r in rows} <= wanted and len(rows) >= 0.99 * len(wanted)
            assert all(r.text == kept[r.doc_id].text and r.lang is not None for r in rows)
        elif name == "near_duplicates":
            found = brute([(i, r.text) for i, r in kept.items()], 80)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in found.items() if i == c)
        elif name == "secrets":
            assert {r.doc_id: r.text for r in rows} == {i: secret_scan.redacted(r.text, secret_scan.scan(r.text)) for i, r in kept.items()}
            assert any(r.text != kept[r.doc_id].text for r in rows)
        elif name == "mixing":
            taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs).collect()}
            times = Counter(r.doc_id for r in rows)
            assert all(abs(times[i] - t / max(1, n)) <= 0.5 for i, (n, t) in taken.items())
        else:
            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
            for r in rows:
                ids = model.encode(kept[r.doc_id].text)
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        docs, kept = out, {r.doc_id: r for r in rows}


def test_empty_documents(spark, given):
    docs = given.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert docs.count() == 0


def test_registered_once_per_operator():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert "pipeline" in entry.queries() and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "mixing", "sentencepiece"]
