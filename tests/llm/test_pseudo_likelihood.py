import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pseudo_likelihood as M


def plain_score(net, words):
    """The sum over words of the log of a softmax computed for one masked word at a time."""
    ids = net.classes.of(words).tolist()
    total = 0.0
    for i, target in enumerate(ids):
        places = [i - 2, i - 1, i + 1, i + 2]
        seen = [ids[j] if 0 <= j < len(ids) else net.classes.size for j in places]
        x = sum(net.embed[s].astype(float) @ net.inner[k] for k, s in enumerate(seen)) + net.inner_bias
        h, g, own = np.tanh(x), target // M.GROUP, target % M.GROUP
        for logits, k in ((h @ net.group.astype(float) + net.group_bias, g), (h @ net.own[g].astype(float) + net.own_bias[g], own)):
            total += logits[k] - np.log(np.exp(logits).sum())
    return total


def network():
    classes = M.Classes(["the", "of", "and"])
    share = np.random.default_rng(0).dirichlet(np.ones(classes.size))
    return M.WindowNetwork(classes, share)


def test_scores_match_one_word_at_a_time(spark):
    net = network()
    texts = ["the cat of the House and 42 dogs ...", "", None, "one", "a b", "\t\n", "the " * 20000, "a b"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = {r.doc_id: r for r in M.score(df, net).collect()}
    for i in (0, 3, 4, 7):
        words = texts[i].lower().split()
        assert out[i].n_tokens == len(words)
        assert out[i].log_likelihood == pytest.approx(plain_score(net, words), rel=1e-4)
    assert [(out[i].n_tokens, out[i].log_likelihood, out[i].mean_log_likelihood) for i in (1, 2, 5)] == [(0, 0.0, None)] * 3
    assert out[6].n_tokens == 20000 and np.isfinite(out[6].log_likelihood)
    assert M.score(df.filter(F.lit(False)), net).count() == 0


def test_gradient_lowers_the_loss_and_context_helps():
    rng = np.random.default_rng(1)
    classes = M.Classes(["x0", "x1", "x2", "x3"])
    walk = np.arange(4000) % 4  # each word follows from its neighbours
    ends = np.array([2000, 4000])
    net = M.WindowNetwork(classes, np.full(classes.size, 1 / classes.size))
    before = net.log_probabilities(M.windows(walk, ends, classes.size), walk).mean()
    net.fit(walk.astype(np.int32), ends, epochs=12)
    after = net.log_probabilities(M.windows(walk, ends, classes.size), walk).mean()
    mixed = rng.permutation(walk)
    assert before < np.log(0.1) < np.log(0.7) < after
    assert net.log_probabilities(M.windows(mixed, ends, classes.size), mixed).mean() < after - 1


def test_corpus_statistics_and_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = M.train(docs, sample=100)
    words = [w for r in docs.collect() for w in r.text.lower().split()]
    ids = net.classes.of(words)
    want = (np.bincount(ids, minlength=net.classes.size) + 1) / (len(ids) + net.classes.size)
    shares = np.exp(net.group_bias[:, None] + net.own_bias).ravel()
    assert np.allclose(shares[: len(want)], want, rtol=1e-4) and shares[len(want) :].max(initial=0) < 1e-20
    out = M.score(docs, net).toPandas()
    unigram = np.log(want)[ids].sum()
    assert out.n_tokens.sum() == len(words) and out.log_likelihood.sum() > unigram
    empty = M.train(docs.filter(F.lit(False)))
    assert M.score(docs.limit(3), empty).count() == 3


def test_gradients_are_derivatives_of_the_loss(monkeypatch):
    monkeypatch.setattr(M, "GROUP", 8)
    net = network()
    for name in ("embed", "inner", "inner_bias", "group", "own", "group_bias", "own_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    rng = np.random.default_rng(4)
    goal, context = np.sort(rng.integers(0, net.classes.size, 30)), rng.integers(0, net.classes.size + 1, (30, 4))

    def loss():
        h, g = net.hidden(context), goal // 8
        logs = M._log_softmax(h @ net.group + net.group_bias)[np.arange(30), g]
        return -np.mean([logs[i] + M._log_softmax(h[i : i + 1] @ net.own[g[i]] + net.own_bias[g[i]])[0, goal[i] % 8] for i in range(30)])

    for w, found in zip(net.weights(), net._gradients(context, goal), strict=True):
        for at in rng.integers(0, w.size, 12).tolist():
            base = w.flat[at]
            w.flat[at] = base + 1e-5
            up = loss()
            w.flat[at] = base - 1e-5
            assert found.flat[at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
            w.flat[at] = base


def test_large_logits_stay_finite():
    net = network()
    net.group *= 1e5
    net.own *= 1e5
    assert np.isfinite(net.log_probabilities(np.zeros((5, 4), dtype=int), np.arange(5))).all()
