"""The network's weights come from all documents, not only from the sample."""

import numpy as np

from tidemark.llm import pseudo_likelihood as M


def test_context_outside_the_sample_is_learned(spark):
    walk = " ".join(f"x{i % 8}" for i in range(400))
    docs = spark.createDataFrame([(k, walk) for k in range(400)] + [(1000, None), (1001, "")], "doc_id long, text string").coalesce(2)
    net = M.train(docs, sample=0, frequent=8)
    out = M.score(docs.filter("doc_id < 3"), net).collect()
    # Each word follows from its neighbours; by its share alone it has a log-probability of about -2.08.
    assert all(r.mean_log_likelihood > np.log(1 / 8) + 1 for r in out)


def test_a_pass_in_two_chunks_carries_the_moments_on():
    classes = M.Classes(["a", "b"])
    new = lambda: M.WindowNetwork(classes, np.full(classes.size, 1 / classes.size))
    words, ends, state = np.tile(np.array([0, 1], dtype=np.int32), 2000), np.array([4000]), {}
    net = new().fit(words, ends, epochs=1, state=state).fit(words, ends, epochs=1, state=state)
    assert state["step"] == 2 * -(-4000 // M.FEWEST) and not np.allclose(net.own, new().fit(words, ends, epochs=1).own)
