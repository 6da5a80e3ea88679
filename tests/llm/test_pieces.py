"""Encoding against the library itself."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spendgrain.llm import pieces
from spendgrain.llm.registry import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CASES = ["", " ", "  ", "a", " a", "a ", "Hello  world", "▁x▁▁y", "tab\tline\nend\r\n", "día 😀 日本語́", "<s></s><unk><0x0A>", "a" * 3000, " x　y", "\x00\x01", "ﬁ①"]


def check(text):
    ids, n, decoded, begins, ends = pieces.encoder(PATH).encode(text)
    wanted = LIBRARY.encode(text)
    assert ids == ",".join(map(str, wanted)) and n == len(wanted)
    assert decoded == LIBRARY.decode(wanted)
    data = text.encode()
    assert len(begins) == len(ends) == n
    assert (begins[1:] == ends[:-1]).all() and (begins <= ends).all()
    if n:
        assert begins[0] == 0 and ends[-1] == len(data)
    for i, a, b in zip(wanted, begins.tolist(), ends.tolist(), strict=True):
        if not LIBRARY.is_byte(i):
            piece = LIBRARY.id_to_piece(i).replace("▁", " ")
            said = data[a:b].decode().replace("▁", " ")
            assert said == piece or (a == 0 and " " + said == piece)


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    check(text)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.one_of(st.sampled_from("ab AB▁\n\t.é"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    check(text)


def test_the_table_query_digests_what_the_library_says(spark):
    rows = [(i, t, 5) for i, t in enumerate(CASES)] + [(None, None, 1), (1, "again", 2), (1, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = pieces.encode(docs, PATH, ("n_tokens", "ids", "begins", "ends", "decoded", "ids_sha256", "decoded_sha256", "spans_sha256")).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert (r.n_tokens, r.ids, r.decoded) == (0, [], "")
        elif r.decoded != "again":
            ids = LIBRARY.encode(CASES[r.doc_id])
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_a_compiled_map_is_followed_like_the_library_does():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False)
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(normalizer.serialized_model_proto())
    own = pieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    encoder = pieces.encoder(PATH)
    old, encoder.map = encoder.map, own
    try:
        for text in ["plain", "ﬁne ①②", "ｆｕｌｌ", "étude", "ガ", "a​b", "日本", " ", "½", "x\ty"]:
            body, source = encoder.normalised(text)
            assert body[1:].replace("▁", " ") == normalizer.normalize(text)
            assert len(source) == len(body.encode()) + 1 and (np.diff(source) >= 0).all()
            assert source[-1] == len(text.encode())
    finally:
        encoder.map = old
