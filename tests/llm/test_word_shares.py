"""Every word is predicted, not only its class."""

from collections import Counter

import numpy as np
import pytest
from test_pseudo_likelihood import plain_score

from tidemark.llm import pseudo_likelihood as M


@pytest.mark.parametrize("known", [0, 3, 1000])
def test_words_of_one_class_are_told_apart(spark, known):
    texts = ["the cattles cattles cattles farmers the 42 " * 20, "the zzqqxxy farmers", "", None, "the été é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = M.word_counts(docs)
    net = M.train(docs, frequent=2, counts=counts)
    shares = M.word_shares(counts, net.classes, known=known)
    assert len(shares.vocabulary.known) <= known
    new = [(10, "the cattles"), (11, "the farmers"), (12, "the zzqqxxy"), (13, "the qwertyu"), (14, "the " + "q" * 13), (15, "the " + "q" * 40), (16, "the été farmers farmers"), (17, ""), (18, None)]
    out = {r.doc_id: r for r in M.score(spark.createDataFrame(new, "doc_id long, text string"), net, shares=shares).collect()}
    seen = Counter(w for t in texts for w in (t or "").split())
    size = Counter()
    for w, n in seen.items():
        size[int(net.classes.of([w])[0])] += n
    for k, t in new[:7]:
        words, want = t.split(), plain_score(net, t.split())
        for w, c in zip(words, net.classes.of(words).tolist(), strict=True):
            if w not in net.classes.number:
                want += np.log(seen[w] or 257.0 ** -(len(w.encode()) + 1)) - np.log(size[c] + 1)
        assert out[k].log_likelihood == pytest.approx(want, rel=1e-4), t
        assert out[k].mean_log_likelihood == pytest.approx(want / len(words), rel=1e-4)
    assert out[11].log_likelihood > out[12].log_likelihood > out[13].log_likelihood
    assert out[14].log_likelihood > out[15].log_likelihood
    assert [(out[k].n_tokens, out[k].log_likelihood, out[k].mean_log_likelihood) for k in (17, 18)] == [(0, 0.0, None)] * 2


def test_words_are_parted_alike_where_they_are_counted_and_scored(spark):
    text = " ".join(["alpha\u00a0beta gamma\x1cdelta\x85x\tfull\u3000width"] * 3)
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    counts = M.word_counts(docs)
    assert {r.word: r.n for r in counts.collect()} == {"alpha\u00a0beta": 3, "gamma\x1cdelta\x85x": 3, "full\u3000width": 3}
    net = M.train(docs, frequent=2, counts=counts)
    out = M.score(docs, net, shares=M.word_shares(counts, net.classes)).first()
    assert out.n_tokens == 9
    unseen = spark.createDataFrame([(1, text.replace("\u00a0", " "))], "doc_id long, text string")
    assert M.score(unseen, net, shares=M.word_shares(counts, net.classes)).first().n_tokens == 12
