import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, id long"


def scaled(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def usable(rows):
    for k, v, label in rows:
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and sum((256.0 * np.float64(np.float32(x))) ** 2 for x in v) < 2.0**62:
            yield k, scaled(v), str(label)


def brute(rows, positives=5, negatives=10):
    used, out = list(usable(rows)), []
    asked = {}
    for k, v, label in used:
        if k % 100 == 0:
            asked[k] = min(asked.get(k, (label, v)), (label, v))
    for a, (label, v) in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k, other) for k, w, other in used if k != a)  # noqa: B905
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, 7) for r in rows], SCHEMA)
    out = H.hard_negatives(df, F.col("vec_id") % 100 == 0, **options)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def vectors(n, dims, seed, labels=3, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (5, dims))
    return [(i, [float(x) for x in centres[rng.integers(5)] + rng.normal(0, spread, dims)], int(rng.integers(labels))) for i in range(n)]


def test_against_brute_force_with_odd_rows(spark):
    rows = vectors(450, 9, 1)
    rows += [(None, rows[0][1], 1), (500, None, 1), (600, [1.0, None], 1), (700, [math.nan] * 9, 1), (701, [math.inf] * 9, 1), (800, rows[5][1], None), (900, [], 1), (901, [2.5], 1)]
    rows += [(1000, [3e38] * 3, 1), (1001, [1e30], 2)]  # too long for scores that fit
    rows += [(1100 + i, rows[100][1], i % 3) for i in range(40)]  # ties
    rows += [(100, rows[7][1], 2), (100, rows[8][1], 0), (300, *rows[300][1:]), (301, *rows[301][1:])]  # repeated keys
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("cuts", [(7, 3, 2), (1024, 50, 1)])
def test_any_blocks_give_the_same(spark, cuts, monkeypatch):
    rows = vectors(260, 6, 2)
    monkeypatch.setattr(H, "PACK", cuts[0])
    monkeypatch.setattr(H, "ROWS", cuts[1])
    monkeypatch.setattr(H, "ANCHORS", cuts[2])
    assert found(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 0.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.25, 0.0], 2), (3, [0.45, 0.0], 2), (4, [-1.0, 0.0], 2), (5, [-1.0, 0.0], 1)]
    assert found(spark, rows) == brute(rows) and found(spark, rows)[0] == (0, 1, 1, 3, 32768, 256 * 115)
    assert found(spark, rows, positives=1, negatives=1) == brute(rows, 1, 1)


@pytest.mark.parametrize("most", [3, 900, 2**20, 2**28])
@pytest.mark.parametrize("dims", [1, 64, 5000])
def test_residues_give_exact_signed_products(most, dims):
    rng = np.random.default_rng(most + dims)
    a, b = (rng.integers(-most, most + 1, (n, dims)) for n in (5, 11))
    a[0], b[0], b[1] = most, most, -most  # the largest scores there are
    longest = [math.isqrt(int(max((x.astype(object) ** 2).sum(axis=1)))) + 1 for x in (a, b)]
    primes = H.primes_for(dims, longest[0] * longest[1])
    h = (primes[0] - 1) // 2
    assert min(dims, H.TILE_DIMS) * h * h < 2**24 and math.prod(primes) > 2 * longest[0] * longest[1]
    if math.prod(longest) < 2**62:
        got = H.exact_products(H.Residues(a.astype(float), primes).parts, H.Residues(b.astype(float), primes).parts, primes)
        assert (got == (a.astype(object) @ b.astype(object).T).astype(np.int64)).all()


def test_best_prefers_small_columns_among_ties():
    scores = np.array([[5, 7, 7, 7, 1], [H.LOW, 2, H.LOW, 2, H.LOW]])
    row, col = H.best(scores, 2)
    assert row.tolist() == [0, 0, 1, 1] and col.tolist() == [1, 2, 1, 3]
    assert H.best(scores, 9)[1].tolist() == [1, 2, 3, 0, 4, 1, 3]
