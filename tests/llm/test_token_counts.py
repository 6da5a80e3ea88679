"""Counts against the libraries, and what the cache holds."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendgrain.llm import token_counts
from spendgrain.llm.registry import tokenizer_path

WORD, BYTE, PIECE = (tokenizer_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    None,
    "",
    " ",
    "Hello  World",
    "hello world",
    "HELLO\t\nWORLD",
    "é É é É H̱ ẖ İ ẞ ß",
    "<|endoftext|> a <|ENDOFTEXT|> <|startoftext|>",
    "<|EndOfText|>",
    "<|endoftext|≯",
    "a b\x1cc\x85d",
    "x" * 200_000,
    "the cat " * 20_000,
    "\x00 nul",
    "they're 100% o'clock",
]


def library(path, text):
    if path.endswith(".model"):
        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))
    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_counts_are_those_of_the_library(spark, tmp_path, path):
    rows = [(i, t, "d", 0) for i, t in enumerate(TEXTS)] + [(None, "Hello  World", "d", 1), (3, "Hello  World", "d", 1), (3, "other", "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens int")
    found = token_counts.token_counts(docs, path, f"{tmp_path}/cache", limit=5)
    wanted = [(i, len((t or "").encode()), library(path, t), library(path, t) > 5) for i, t, *_ in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_only_missing_contents_are_encoded(spark, tmp_path, monkeypatch):
    folder, schema = f"{tmp_path}/cache", "doc_id long, text string"
    own = f"{folder}/{token_counts.tokenizer_digest(WORD)}"
    first = spark.createDataFrame([(i, f"text {i % 10}") for i in range(100)] + [(200, "TEXT  1"), (201, "Text\n2")], schema)
    for few in (token_counts.FEW, 0):  # the second run finds all, whichever way digests are joined
        monkeypatch.setattr(token_counts, "FEW", few)
        assert token_counts.token_counts(first, WORD, folder).count() == 102
        assert spark.read.parquet(own).count() == 10
    more = first.union(spark.createDataFrame([(300, "new"), (301, "NEW"), (302, "text 3")], schema))
    assert token_counts.token_counts(more, WORD, folder).where("n_tokens IS NULL").count() == 0
    assert spark.read.parquet(own).count() == 11
    token_counts.token_counts(first, BYTE, folder).collect()
    assert spark.read.parquet(f"{folder}/{token_counts.tokenizer_digest(BYTE)}").count() == 12
    assert spark.read.parquet(own).count() == 11


def test_stored_counts_are_used_and_repeats_do_no_harm(spark, tmp_path):
    folder = f"{tmp_path}/cache"
    digest = F.unhex(F.sha2(F.lit("abc"), 256)).alias("digest")
    for _ in range(2):
        spark.range(1).select(digest, F.lit(77).cast("long").alias("n_tokens")).write.mode("append").parquet(f"{folder}/{token_counts.tokenizer_digest(WORD)}")
    docs = spark.createDataFrame([(1, "ABC"), (2, "abc"), (3, "abc d")], "doc_id long, text string")
    assert sorted(map(tuple, token_counts.token_counts(docs, WORD, folder).collect())) == [(1, 3, 77, False), (2, 3, 77, False), (3, 5, 2, False)]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(docs, WORD, f"{tmp_path}/cache").collect() == []
    assert token_counts.cached(spark, f"{tmp_path}/cache", token_counts.tokenizer_digest(WORD)).count() == 0


def test_unknown_kind():
    with pytest.raises(ValueError, match="no library"):
        token_counts.tokenizer_digest("words.txt")


@pytest.mark.parametrize("path", [WORD, BYTE, PIECE])
def test_normal_form_keeps_the_count(spark, path):
    rng = random.Random(5)
    parts = ["a", "B", "z", " ", "  ", "\t", "\n", "\r", "\x0b", "\x1c", "<|", "|>", "<|endoftext|>", "EndOfText", "'S", "0", "!", "é", "\u0301", "İ"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    forms = [r[0] for r in docs.select(token_counts.normal_content(F.col("text"), path)).collect()]
    count = token_counts.counter(path)
    assert count(texts) == count(forms)
    assert (len(set(forms)) < len(set(texts))) == (path == WORD)
