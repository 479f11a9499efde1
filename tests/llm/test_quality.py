import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm.words import WordTable, sums_by_text


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = Q.FactorisationMachine(50)
    m.weight, m.bias = rng.normal(size=50), 0.3
    features, values = rng.choice(50, 12, replace=False), rng.normal(size=12)
    pairs = sum(m.vectors[features[i]] @ m.vectors[features[j]] * values[i] * values[j] for i, j in combinations(range(12), 2))
    want = 0.3 + (m.weight[features] * values).sum() + pairs
    got = m.raw(np.zeros(12, dtype=np.int64), features, values, 2)
    assert got == pytest.approx([want, 0.3])


def test_machine_learns_a_pair_that_no_single_weight_can():
    rows = [(np.array([0, 2]), np.ones(2)), (np.array([0, 3]), np.ones(2)), (np.array([1, 2]), np.ones(2)), (np.array([1, 3]), np.ones(2))] * 100
    labels = np.array([1, 0, 0, 1] * 100)
    m = Q.FactorisationMachine(4).fit(rows, labels, epochs=80)
    found = [m.score(np.zeros(2, dtype=np.int64), *r, 1)[0] for r in rows[:4]]
    assert [s > 0.5 for s in found] == [True, False, False, True]


def test_word_table_forgets_without_changing_rows():
    small = WordTable(lambda w: np.array([[len(x)] for x in w]), most=2)
    for _ in range(3):
        rows, ends = small.look_up(["a bb", "", "ccc a dddd"])
        assert rows[:, 0].tolist() == [1, 2, 3, 1, 4] and ends.tolist() == [2, 2, 5]
        assert sums_by_text(rows, ends)[:, 0].tolist() == [3, 0, 8]


def test_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    m = Q.train(docs, labels.filter(fold != 1), "quality", metadata=("n_chars",))
    out = Q.score(docs, m, metadata=("n_chars",)).join(labels, "doc_id").filter(fold == 1).toPandas()
    good, bad = out.score[out.quality == 1], out.score[out.quality == 0]
    assert len(bad) > 5 and ((good.values[:, None] > bad.values[None, :]).mean()) > 0.95
    odd = spark.createDataFrame([(1, None, None, 1), (2, "", 0, 1), (None, "a b", 3, 1), (4, "x " * 60000, 120000, 1), (4, "x " * 60000, 120000, 1)], "doc_id long, text string, n_chars long, score int")
    got = Q.score(odd, m, metadata=("n_chars",)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert Q.score(odd.filter(F.lit(False)), m, metadata=("n_chars",)).count() == 0
    none = Q.train(docs, labels.filter(F.lit(False)), "quality")
    assert all(abs(r.score - 0.5) < 0.1 for r in Q.score(odd, none).collect())


def plain_features(text, metadata):
    """number -> value, word by word and statistic by statistic."""
    words = (text or "").split()
    out = Counter(zlib.crc32(w.lower().encode()) % Q.BUCKETS for w in words)
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in out.values()))
    out = {b: math.log1p(n) / norm for b, n in out.items()}
    n, buckets = len(words), [zlib.crc32(w.lower().encode()) % Q.BUCKETS for w in words]
    lines = [x for x in (text or "").split("\n") if x.strip()]
    share = lambda test: sum(map(test, words)) / n
    stats = [0.0] * len(Q.STATISTICS)
    if n:
        stats = [
            min(1.0, math.log2(1 + n) / 16), share(lambda w: len(w) > 1 and w.isupper()), share(lambda w: not w.isalpha() and any(c in "#*$%&|<>{}[]\\^~_=+@" for c in w)),
            share(lambda w: "!!" in w), share(lambda w: w in ("|", ">", "»", "•")), share(lambda w: not w.isalpha() and any(c.isdigit() for c in w)),
            sum(a == b for a, b in zip(buckets, buckets[1:])) / (n - 1) if n > 1 else 0.0, len(set(buckets)) / n, sum(min(len(w), 40) for w in words) / n / 40,  # noqa: B905
            min(1.0, math.log2(1 + len(lines)) / 12), sum(not x.rstrip().endswith(tuple(".!?…:;\"'”»)")) for x in lines) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        ]
    for i, x in enumerate([*stats, None if metadata is None else math.log2(1 + abs(metadata)) / 40]):
        place = Q.BINS if x is None else 0 if x == 0 else max(1, min(int(x * Q.BINS), Q.BINS - 1))
        out[Q.BUCKETS + i * (Q.BINS + 1) + place] = 0.5
    return out


def test_scores_match_brute_force_over_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "n_chars").filter("n_chars < 900").limit(25)
    odd = [(-1, None, None), (-2, "", 0), (-3, "BUY NOW!! | 50% 50% x_1\nx\nx\n\n done.", 7), (-3, "BUY NOW!! | 50% 50% x_1\nx\nx\n\n done.", 7), (-4, "a " * 400, 10**9)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, n_chars long"))
    m = Q.FactorisationMachine(Q.BUCKETS + (len(Q.STATISTICS) + 1) * (Q.BINS + 1))
    m.weight, m.bias = np.random.default_rng(3).normal(0, 0.3, len(m.weight)), -0.2
    got = {r.doc_id: r.score for r in Q.score(docs, m, metadata=("n_chars",)).collect()}
    for r in docs.collect():
        f = plain_features(r.text, r.n_chars)
        raw = m.bias + sum(m.weight[i] * x for i, x in f.items()) + sum(m.vectors[i] @ m.vectors[j] * x * y for (i, x), (j, y) in combinations(f.items(), 2))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9), r.text


def test_repeated_keys_and_labels_are_bounded_by_the_sample(spark):
    docs = spark.createDataFrame([(1, "good text", i) for i in range(50)] + [(2, "bad | text", 0)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (2, None)], "doc_id long, quality int")
    a, b = (Q.train(docs, labels, "quality", metadata=("n_chars",), sample=10) for _ in range(2))
    assert np.array_equal(a.vectors, b.vectors) and a.bias == b.bias
