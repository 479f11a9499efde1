import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tidemark.llm import language as L  # noqa: E402


def all_segmentations(word, prob):
    if not word:
        return 1.0
    total = 0.0
    for cut in range(1, len(word) + 1):
        if word[:cut] in prob:
            total += prob[word[:cut]] * all_segmentations(word[cut:], prob)
    return total


PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "bab", "c"]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    prob = rng.dirichlet(np.ones(len(PIECES)), 2).T
    own = L.Pieces(PIECES, prob)
    for word in ["a", "ab", "abab", "babcab", "c" * 5]:
        for k in range(2):
            want = all_segmentations("▁" + word, dict(zip(PIECES, prob[:, k], strict=True)))
            assert own.log_likelihoods([word, "ab"])[0, k] == pytest.approx(math.log(want))
    assert own.log_likelihoods(["xyz"])[0, 0] < own.log_likelihoods(["ab"])[0, 0]
    assert np.isfinite(own.log_likelihoods(["ab" * 5000, "ü" * 900])).all()


def exact_sums(word, prob):
    """The log of the sum over all segmentations, in exact fractions."""
    sums = [Fraction(1)] + [Fraction(0)] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 3), j):
            if word[i:j] in prob:
                sums[j] += sums[i] * Fraction(prob[word[i:j]])
    top = sums[-1]
    return math.log(top.numerator) - math.log(top.denominator)


@pytest.mark.parametrize("n", [30, 31, 32, 33, 64, 120, 1000])
def test_long_words_have_all_their_segmentations_too(n):
    prob = np.random.default_rng(2).dirichlet(np.ones(len(PIECES)), 2).T
    own, word = L.Pieces(PIECES, prob), ("ababcbab" * n)[:n]
    found = own.log_likelihoods([word, "ab"])
    for k in range(2):
        assert found[0, k] == pytest.approx(exact_sums("▁" + word, dict(zip(PIECES, prob[:, k], strict=True))), rel=1e-9)
    counts = np.zeros(len(PIECES))
    own.expected(word, 0, 1.0, counts)
    assert sum(c * len(p) for c, p in zip(counts, PIECES, strict=True)) == pytest.approx(n + 1)  # every character is used once


def test_runs_keep_combining_marks_and_part_at_all_else():
    assert L.letter_runs("don't") == ["don", "t"] and L.letter_runs("x1y") == ["x", "y"] and L.letter_runs("--") == []
    assert L.letter_runs("हिन्दी") == ["हिन्दी"] and L.letter_runs("ที่นี่") == ["ที่นี่"] and L.letter_runs("Cafe\u0301!") == ["cafe\u0301"]


def test_marks_and_apostrophes_count_in_training_as_in_prediction(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("हिन्दी में लिखा है", "hi"), ("ที่นี่ดีมาก", "th"), ("don't you can't", "en")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, sorted({c for _, t, _ in rows for c in t.lower()} | {"▁"}))
    asked = spark.createDataFrame([(1, "हिन्दी!"), (2, "ที่นี่"), (3, "Can't"), (4, "\u0301 42")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.predict(asked, model).collect()} == {1: "hi", 2: "th", 3: "en", 4: "und"}


def test_equal_likelihoods_go_to_the_first_language_and_the_sample_is_bounded_for_each(spark):
    rows = [(1, "aa bb", "y"), (1, "aa bb", "y"), (2, "aa bb", "x"), (3, "aa bb", "x")] + [(None, "aa bb", "z")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, ["▁", "a", "b"], sample=2)
    assert model.languages == ["x", "y", "z"] and np.allclose(model.probability, model.probability[:, :1])
    assert {r.lang_pred for r in L.predict(docs, model).collect()} == {"x"}


def test_expected_uses_are_derivatives_of_the_log_likelihood():
    prob = np.random.default_rng(1).dirichlet(np.ones(len(PIECES)), 1).T
    counts = np.zeros(len(PIECES))
    L.Pieces(PIECES, prob).expected("ababcab", 0, 3.0, counts)
    for i in range(len(PIECES)):
        up = prob.copy()
        up[i, 0] *= 1 + 1e-6
        change = (L.Pieces(PIECES, up).log_likelihoods(["ababcab"]) - L.Pieces(PIECES, prob).log_likelihoods(["ababcab"]))[0, 0]
        assert counts[i] == pytest.approx(3 * change / 1e-6, abs=1e-3)


def test_documents(spark):
    sf = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(sf)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = L.train(docs.filter(fold != 2), L.vocabulary(P.path("piece_bpe_32k.model")))
    out = L.predict(docs, model).join(docs, "doc_id").filter(fold == 2).select("lang", "lang_pred", "score").collect()
    assert len(out) > 30 and np.mean([r.lang == r.lang_pred for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 -- !!", 1), (None, "the and of", 1), (4, "x" * 100000, 1), (4, "x" * 100000, 1)], "doc_id long, text string, score int")
    got = [(r.doc_id, r.lang_pred) for r in L.predict(odd, model).collect()]
    assert [g for g in got if g[1] == "und"] == [(1, "und"), (2, "und"), (3, "und")] and (None, "en") in got and len(got) == 6
    assert L.predict(odd.filter(F.lit(False)), model).count() == 0
    nothing = L.train(docs.withColumn("lang", F.lit(None).cast("string")), L.vocabulary(P.path("piece_bpe_32k.model")))
    assert {r.lang_pred for r in L.predict(odd, nothing).collect()} == {"und"}


def test_sums_that_underflow_are_kept_as_logarithms():
    letters = [L.START, *"abcdefgh"]
    few = np.full((len(letters), 2), 0.05 / 1e9)
    few[:, 1] *= 0.5
    model = L.Pieces(letters, few)
    words = ["abcdefg" * 4 + "abc"[:k] for k in range(3)] + ["a", "abcdefgh" * 9]
    got = model.log_likelihoods(words)
    want = np.array([[(len(w) + 1) * np.log(p) for p in few[0]] for w in words])
    assert np.allclose(got, want, rtol=1e-9)
    counts = np.zeros(len(letters))
    model.expected("abcdefgh" * 3 + "abcdefg", 0, 2.0, counts)
    assert np.allclose(counts, [2, 8, 8, 8, 8, 8, 8, 8, 6])
