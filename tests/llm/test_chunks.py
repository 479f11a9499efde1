"""Texts are cut before spaces and newlines; whether a chunk is a word is found once for each chunk."""

import pytest

P = pytest.importorskip("public_tokenizers")
from tidemark.llm import byte_bpe as B  # noqa: E402


def test_chunks_that_are_words():
    assert B.chunks("a b\nc") == ["a", " b", "\nc"]
    assert [c for c in ["a", " b", "\nc", "é", " x.1", "", " ", "\n", "a\tb", " a ", " a", "\x0ba", "\x1fa"] if B.is_word(c)] == ["a", " b", "\nc", "é", " x.1"]


def test_odd_spaces_are_cut_by_the_pattern_whatever_was_seen_before():
    new = lambda most=1_000_000: B.TextEncoder(B.text_encoder(P.path("byte_bpe_50k.json"), P.PATTERN).bpe, most)
    texts = ["a b", "a  b", "a   b", " a", "a ", "a\n\n\nb", "a b", "\0 x y", "x\0 y", "", "  ", "\n", "a\tb c", "don't stop, it's 12345 .", "　x 日本 語", "a   b", "one  two\nthree"]
    for order in (texts, texts[::-1]):
        for encoder in (new(), new(3)):
            for _ in range(2):
                ids, ends = encoder.encode(order)
                assert [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)] == [encoder.bpe.encode(t) for t in order]
    assert new().encode([])[1].tolist() == []
