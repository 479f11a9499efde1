import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
from tidemark.llm import byte_bpe as B  # noqa: E402

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ENCODER = B.text_encoder(PATH, P.PATTERN)
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ENCODER.bpe.ranks, special_tokens={})
HARD = ["", " ", "\n", "a", "  a  b\n\n\nc\t d 's", "x\x1cy z", "a\0b c", "日本語 の\nテキスト", "a" * 3000, "ab " * 50, "é" * 90, "don't  stop", "<|endoftext|>", "a \n b"]


def one(text):
    ids, ends = ENCODER.encode([text])
    assert ends.tolist() == [len(ids)]
    return ids.tolist()


@pytest.mark.parametrize("text", HARD)
def test_ids_are_those_of_the_public_library(text):
    assert one(text) == ORACLE.encode_ordinary(text) == ENCODER.bpe.encode(text)
    assert ENCODER.bpe.decode(one(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abth eén\n\t's1.,!日 "), max_size=60))
def test_random_texts(text):
    assert one(text) == ORACLE.encode_ordinary(text)


def test_long_and_short_merges_agree():
    piece = b"theanreouthining" * 4
    assert ENCODER.bpe.encode_one(piece) == ENCODER.bpe.encode_many([piece])[0].tolist()


def test_forgetting_does_not_change_ids():
    small = B.TextEncoder(ENCODER.bpe, most=3)
    for text in HARD * 2:
        assert small.encode([text])[0].tolist() == ORACLE.encode_ordinary(text)


def test_json_vocabulary_matches_its_library():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    own = B.text_encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    for text in HARD:
        assert own.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids


def test_columns(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, ids="clash", decoded=1) for i, t in enumerate([*HARD, None, "same", "same"])])
    out = {r.doc_id: r for r in B.encode_column(docs, PATH, P.PATTERN).collect()}
    for i, t in enumerate([*HARD, "", "same", "same"]):
        want = ORACLE.encode_ordinary(t)
        assert out[i].ids == want
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert bytes(out[i].decoded) == t.encode()
    back = B.decode_column(spark.createDataFrame([(1, [72]), (2, None)], "doc_id long, ids array<int>"), PATH, P.PATTERN)
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: bytearray(ENCODER.bpe.decode([72])), 2: None}
    assert B.encode_column(docs.filter(F.lit(False)), PATH, P.PATTERN).count() == 0
