"""Shards against the tokenizer itself, and exact round trips."""

import json
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spendgrain.llm import grammar
from spendgrain.llm.common import stored
from spendgrain.llm.registry import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OTHER = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.one_of(st.sampled_from("ab AB \n\t.'é1²_"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_those_of_the_library(text):
    assert grammar.encoder(PATH).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|> a", "a b", "a \n  b", "it's we'll", "x" * 5000, "a\x1cb", "  lead", "trail  "])
def test_cases(text):
    assert grammar.encoder(PATH).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a 𝟙𝟚 b", "x𐄇y 𐄇", "🙂 ok🙂", "𝒜𝒷 c", "½ 𝟘½", "a\x0bb", "a\u3000b 🙂", "㉈ ⅷ"])
def test_characters_that_libraries_class_differently(text):
    assert grammar.encoder(PATH).encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_odd_characters_are_found_one_by_one():
    own = grammar.encoder(PATH)
    odd = {*grammar.odd_numbers(), *(chr(c) for a, b in grammar.ODD_SPACE for c in range(a, b + 1))}
    assert {c for c in map(chr, range(0x110000)) if own._odd(f"a{c}b")} == odd


class Counted:
    """A library that counts the texts it is given."""

    def __init__(self, model):
        self.model, self.texts = model, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.model.encode_batch_fast(texts, **options)


def test_new_words_go_to_the_library_as_lines():
    own = grammar.Encoder(PATH)
    own.model = counted = Counted(own.model)
    text = "".join(f" {w}" for w in map("".join, np.random.default_rng(0).choice(list("abcdefgh"), (10_000, 9)).tolist()))
    assert own.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert counted.texts < 200
    counted.texts = 0
    assert own.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert not counted.texts


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("ab AB \n\t\r.'é×1²_\xa0"), st.characters(codec="utf-8")), max_size=30), st.just("x<|endoftext|>"), st.just("endoftext|>")), max_size=8))
def test_columns_of_texts(texts):
    for path, library, remembered in ((PATH, LIBRARY, 3), (PATH, LIBRARY, 600_000), (tokenizer_path("word_bpe_49k.json"), OTHER, 600_000)):
        own = grammar.encoder(path)
        own.remembered = remembered
        ids, ends = own.encode_column(pa.array([None, *texts], pa.string()).slice(1))
        own.remembered = 600_000
        found = [x.tolist() for x in np.split(ids, ends)[: len(texts)]]
        assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_unknown_bytes_are_no_line_ends(tmp_path):
    spec = json.loads(LIBRARY.to_str())
    vocab = {x: i for i, x in enumerate(["a", "b", "\u010a", "\u0120"])}
    spec["model"] |= {"vocab": vocab, "merges": [], "unk_token": "\u010a"}
    spec["added_tokens"] = []
    path = tmp_path / "small.json"
    path.write_text(json.dumps(spec))
    text = "ab ba\nxa ab"
    assert grammar.Encoder(str(path)).encode(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("first", [50, 100_000])
def test_pairs_are_found_by_table_and_by_search(monkeypatch, first):
    ids = np.random.default_rng(0).integers(0, 40, 50_000)
    symbols, rules = grammar.re_pair(ids, first)
    monkeypatch.setattr(grammar, "CELLS", 0)
    searched = grammar.re_pair(ids, first)
    assert len(rules) and (searched[0] == symbols).all() and (searched[1] == rules).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), min_size=1, max_size=6))
def test_round_trip_and_random_access(docs):
    ids = [np.array([*d, grammar.END]) for d in docs]
    data = grammar.shard_bytes(list(range(len(docs))), [len(x) for x in ids], np.concatenate(ids), 7, least=2)
    shard = grammar.Shard.from_bytes(data)
    for k, wanted in enumerate(ids):
        assert shard.document(k).tolist() == wanted.tolist()
        low, high = len(wanted) // 3, len(wanted) - 1
        assert shard.document(k, low, high).tolist() == wanted[low:high].tolist()
    assert shard.ids().tolist() == np.concatenate(ids).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([1, 4464, 4465, 65535, 65536, 70000, 70001, 99999]), max_size=60), min_size=1, max_size=6), st.sampled_from([65536, 65537, 100_000, 1 << 20]))
def test_large_vocabularies(docs, first):
    ids = [np.array([*(x for x in d if x < first), grammar.END]) for d in docs]
    data = grammar.shard_bytes(list(range(len(docs))), [len(x) for x in ids], np.concatenate(ids), first, least=2)
    shard = grammar.Shard.from_bytes(data)
    assert shard.ids().tolist() == np.concatenate(ids).tolist()
    assert [shard.document(k).tolist() for k in range(len(ids))] == [x.tolist() for x in ids]


def test_large_vocabularies_are_compressed_too():
    ids = np.tile([70000, 70001, 5, 70000, 70001, 0], 500)
    symbols, rules = grammar.re_pair(ids, 100_000)
    assert len(symbols) < len(ids) / 2 and rules.max() >= 70000


@pytest.mark.parametrize("ids", [[1, 70000, 0], [-1, 0]])
def test_ids_outside_the_vocabulary_are_refused(ids):
    with pytest.raises(ValueError, match="ids must lie"):
        grammar.re_pair(np.array(ids), 50_000)


def test_memory_of_long_rules_is_that_of_the_answer():
    ids = np.tile(np.append(np.random.default_rng(0).integers(1, 5000, 40_000), 0), 8)
    data = grammar.shard_bytes(list(range(8)), [40_001] * 8, ids, 5000)
    shard = grammar.Shard.from_bytes(data)
    tracemalloc.start()
    assert (shard.document(7, 39_000, 39_010) == ids[39_000:39_010]).all()
    assert tracemalloc.get_traced_memory()[1] < 300_000
    tracemalloc.reset_peak()
    assert (shard.ids() == ids).all()
    assert tracemalloc.get_traced_memory()[1] < 60 * len(ids)
    tracemalloc.stop()


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.one_of(st.sampled_from("ab AB e\u0301\n\t.'é1²_"), st.characters(codec="utf-8")), max_size=60))
def test_other_tokenizers_encode_whole_texts(text):
    path = tokenizer_path("word_bpe_49k.json")
    assert grammar.encoder(path).encode(text).tolist() == OTHER.encode(text, add_special_tokens=False).ids


def test_only_known_files_are_cut_into_words():
    assert grammar.encoder(PATH).by_word and not grammar.encoder(tokenizer_path("word_bpe_49k.json")).by_word
    spec = json.loads(LIBRARY.to_str())
    changes = ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"end_of_word_suffix": "x"}}, {"truncation": {"max_length": 3}})
    assert not any(grammar.parts_at_words(spec | change) for change in changes)


def test_frequent_pairs_become_symbols():
    ids = np.tile([5, 6, 5, 6, 9, 0], 500)
    symbols, rules = grammar.re_pair(ids, 10)
    assert len(symbols) < len(ids) / 2 and len(rules)


def test_rounds_go_on_while_pairs_are_frequent():
    ids = np.tile([*range(1, 201), 0], 5000)
    symbols, rules = grammar.re_pair(ids, 300)
    assert len(symbols) == 2 * 5000
    assert grammar.lengths_of(rules, 300).max() == 200
    data = grammar.shard_bytes(list(range(5000)), [201] * 5000, ids, 300)
    shard = grammar.Shard.from_bytes(data)
    assert (shard.ids() == ids).all() and shard.document(4999).tolist() == ids[:201].tolist()


def test_rounds_go_on_while_symbols_are_free():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 400, 1 << 20)
    _, rules = grammar.re_pair(ids, grammar.SYMBOLS - 3)
    assert len(rules) == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=2, max_size=300), st.sampled_from([6, grammar.SYMBOLS - 2]))
def test_no_frequent_pair_is_left(ids, first):
    symbols, rules = grammar.re_pair(np.array(ids), first, least=3)
    left, at = {}, 0
    for a, b in zip(symbols.tolist(), symbols[1:].tolist(), strict=False):
        at += 1
        if a and b and left.get((a, b), (0, -1))[1] < at - 1:
            left[a, b] = (left.get((a, b), (0, -1))[0] + 1, at)
    assert len(rules) == grammar.SYMBOLS - first or all(n < 3 for n, _ in left.values())


@pytest.mark.parametrize("tokens", [50, 1 << 22])
def test_files_read_back(spark, tokens):
    texts = ["first text, first text", None, "", "word " * 20000, "same", "same", "Ünïcode 😀"]
    rows = [(10 - i, t, 3) for i, t in enumerate(texts)] + [(None, "no id", 1), (4, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    shards = stored(grammar.encode_shards(docs, PATH, shard_tokens=tokens), "shards")
    found = sorted(grammar.decode_shards(shards).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    assert len(found) == len(rows)
    for r, (name, text, _) in zip(found, ordered, strict=True):
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (name, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = stored(grammar.encode_shards(docs.limit(0), PATH), "shards")
    assert grammar.decode_shards(empty).count() == 0
