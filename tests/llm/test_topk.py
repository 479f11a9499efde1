import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk as T


def brute(vectors, ids, q, own, k):
    scores = [(-int(v @ q), int(i)) for v, i in zip(vectors, ids, strict=True) if i != own]
    return sorted(scores)[:k]


@pytest.mark.parametrize("band", [1, 2, 7])
@pytest.mark.parametrize("kind", ["plain", "ties", "clusters"])
def test_index_is_exact(band, kind):
    rng = np.random.default_rng(band)
    v = rng.integers(-40, 40, (900, 16))
    if kind == "ties":
        v = v // 20 * 20
        v[100:500] = v[100]
    if kind == "clusters":
        v = v // 8 + 30 * rng.integers(-1, 2, (6, 16))[rng.integers(0, 6, 900)]
    ids = rng.permutation(900)
    index = T.ImpactIndex(v, band)
    for q in (0, 5, 150, 300):
        rows, scores = index.top(v[q], 20, ids, int(ids[q]))
        assert [(-int(s), int(ids[r])) for r, s in zip(rows, scores, strict=True)] == brute(v, ids, v[q], ids[q], 20)


@pytest.mark.parametrize("blocks", [(65536, 512), (37, 3)])
def test_query(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)], i) for i in range(200)]
    rows += [(300, None, 0), (301, [1.0, None], 0), (320, [math.nan] * 8, 0), (340, [math.inf] + [0.0] * 7, 0), (None, [1.0] * 8, 0), (360, [], 0), (361, [0.5], 1)]
    rows += [(400 + i, rows[3][1], 0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = T.exact_top_k(df, F.col("vec_id") % 20 == 0, 20, candidates=blocks[0], queries=blocks[1]).collect()
    ok = {i: np.floor(64 * np.pad(np.float32(v), (0, 8 - len(v))).astype(float)).astype(int) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in ok if i % 20 == 0):
        best = brute(list(ok.values()), list(ok), ok[q], q, 20)
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in out} == want
    assert T.exact_top_k(df.filter(F.lit(False)), F.col("vec_id") % 20 == 0).count() == 0
    few = T.exact_top_k(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_repeated_queries_ask_once_and_their_rows_are_candidates_of_others(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 1.0]), (0, [0.5, 1.0])] + [(i, [i / 64, 1.0]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ask = F.col("vec_id") % 5 == 0
    out = T.exact_top_k(df, ask, 4, candidates=3, queries=1).orderBy("query_id", "rank").collect()
    # Query 0 is (32, 64), the smaller of its vectors; query 5 is (5, 64).
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out[:4]] == [(0, i + 1, 5 - i, 32 * (5 - i) + 4096) for i in range(4)]
    assert [(r.rank, r.vec_id, r.score) for r in out[4:]] == [(1, 0, 4256), (2, 0, 4256), (3, 4, 4116), (4, 3, 4111)]


def test_reading_stops_early_when_few_rows_can_be_among_the_best():
    rng = np.random.default_rng(5)
    v = rng.integers(-3, 4, (20000, 16))
    v[:30] += 60
    index, read = T.ImpactIndex(v), []
    plain_read = index._read
    index._read = lambda segments, *rest: (read.append(len(segments)), plain_read(segments, *rest))
    rows, _ = index.top(v[3], 20, np.arange(20000), 3)
    assert set(rows.tolist()) <= set(range(30)) and len(read) < T.LEVELS and sum(read) < len(index.dim)


def test_few_rows_are_scored_exactly_where_vectors_point_anywhere():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(20000, 64))
    v = np.floor(64 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    index, scored, ids = T.ImpactIndex(v), [], np.arange(20000)
    plain_scores = index._scores
    index._scores = lambda rows, query: (scored.append(len(rows)), plain_scores(rows, query))[1]
    for q in range(0, 200, 20):
        rows, scores = index.top(v[q], 20, ids, q)
        assert [(-int(s), int(r)) for r, s in zip(rows, scores, strict=True)] == brute(v, ids, v[q], q, 20)
    assert sum(scored) < 0.1 * 10 * len(v)


def test_large_and_wide_components_are_exact():
    rng = np.random.default_rng(9)
    ids = np.arange(400)
    for scale in (1, 10**3, 10**7):
        v = rng.integers(-40, 40, (400, 16)) * scale + rng.integers(0, 7, (400, 16))
        v[:, 3] = 0
        for q in (0, 7):
            rows, scores = T.ImpactIndex(v).top(v[q], 5, ids, q)
            assert [(-int(s), int(r)) for r, s in zip(rows, scores, strict=True)] == brute(v, ids, v[q], q, 5)
