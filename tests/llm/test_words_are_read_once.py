"""Texts are parted into words once; training and scoring read the numbers of their classes."""

import numpy as np
import pytest
from test_pseudo_likelihood import plain_score

from tidemark.llm import pseudo_likelihood as M
from tidemark.llm.words import ascii_words


def test_training_and_scoring_read_no_texts(spark, monkeypatch):
    texts = ["the cattle of the farmers " * 9, "", None, "the été of x\x1cy é", "the cattle of the farmers " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = M.word_counts(docs)
    classes, share = M.corpus_classes(docs, frequent=3, counts=counts)
    reading = M.read(docs, classes, shares=M.word_shares(counts, classes, known=1))
    plain = M.read(docs, classes)
    for r in plain.table.collect():
        words = ascii_words((texts[r.key] or "").lower())
        assert (r.classes is None) == (texts[r.key] is None) and r.n_tokens == len(words)
        assert np.frombuffer(r.classes or b"", classes.kind).tolist() == classes.of(words).tolist()
    assert "text" not in reading.table.columns
    network = M.fitted(reading, share)
    got = {r.doc_id: r.log_likelihood for r in M.scored(plain, network).collect()}
    for i in (0, 3, 4):
        assert got[i] == pytest.approx(plain_score(network, ascii_words(texts[i].lower())), rel=1e-4)
    whole = {r.doc_id: r.log_likelihood for r in M.scored(reading, network).collect()}
    again = {r.doc_id: r.log_likelihood for r in M.score(docs, network, shares=reading.shares).collect()}
    assert whole == pytest.approx(again, rel=1e-6) and whole[0] < got[0] and whole[1] == whole[2] == 0


def test_many_classes_need_wider_numbers():
    assert M.Classes([f"w{i}" for i in range(40_000)]).kind is np.int32
    words = np.array([39_999, 5, 39_999], dtype=np.int32)
    assert M._order(words).tolist() == [1, 0, 2]


@pytest.mark.parametrize("scale", [1, 300, 1e5])
def test_shifted_and_plain_exponentials_agree(scale):
    rng = np.random.default_rng(2)
    net = M.WindowNetwork(M.Classes(["a", "b"]), rng.dirichlet(np.ones(50)))
    net.own *= scale
    context, goal = rng.integers(0, 51, (40, 4)), np.sort(rng.integers(0, 50, 40))
    assert net._plain() == (scale == 1)
    h = net.hidden(context)
    want = M._log_softmax(h @ net.group + net.group_bias)[np.arange(40), 0] + M._log_softmax(h @ net.own[0] + net.own_bias[0])[np.arange(40), goal]
    assert np.allclose(net.log_probabilities(context, goal), want, rtol=1e-4, atol=1e-4)
    assert all(np.isfinite(g).all() for g in net._gradients(context, goal))
