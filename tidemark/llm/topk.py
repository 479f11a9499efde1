"""Operator 8: exact top-k inner products with an impact-ordered index.

Rows are cut into candidate blocks and query blocks; each pair of blocks is one
group of bounded size whatever the ids are. In a group, the candidates'
components are quantised into bands, and the rows with one dimension's component
in one band are a posting segment. A segment's impact for a query is the largest
product, of either sign, that its band can have. Impacts are quantised into
levels of about equally many postings, and a query reads segments score at a
time: by descending level. Each row's accumulator holds the most that its read
components can add up to. What a row has not been read of is bounded by the best
that is left in each dimension; as the large products of both signs come first,
what is left is small, and soon most accumulators are too low to make up for it.

After a level the rows with the best bounds are scored exactly. A row whose
bound is below the k-th of those scores is proven out for good. Reading stops
once no rows but k are left, or the exact scores of those left cost less than
the next level's postings. Only rows that are left are rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Rows of a candidate block and of a query block.
CANDIDATES, QUERIES = 32768, 8192
#: Bands of a dimension at most (integers have a band each while they are fewer), and levels of quantised impact.
BANDS, LEVELS = 256, 8
#: Postings that one exact score is taken to cost.
EXACT_COST = 64


class ImpactIndex:
    """Posting segments of a block of integer vectors, by dimension and band."""

    def __init__(self, vectors: np.ndarray, band: int | None = None):
        self.vectors = vectors
        self.band = band or 1 + (int(vectors.max(initial=0)) - int(vectors.min(initial=0))) // BANDS
        self.most = float(np.abs(vectors).max(initial=0))
        # Floating point for exact scores: of what size their sums have to stay, as long as it is exact.
        self.exact = 2**24 if self.most < 2**12 else 2**53
        self.floats = vectors.astype(np.float32 if self.exact == 2**24 else np.float64) if self.most < 2**53 else None
        n, dims = vectors.shape
        bands = np.floor_divide(vectors, self.band)
        order = np.argsort(bands, axis=0, kind="stable")
        self.dim, self.level, self.start, self.stop = [], [], [], []
        self.rows = order.T.ravel()
        for d in range(dims):
            own = bands[order[:, d], d]
            cuts = np.concatenate([[0], np.nonzero(own[1:] != own[:-1])[0] + 1]) if n else np.zeros(0, dtype=np.int64)
            self.dim.append(np.full(len(cuts), d))
            self.level.append(own[cuts])
            self.start.append(d * n + cuts)
            self.stop.append(d * n + np.append(cuts[1:], n)[: len(cuts)])
        self.dim, self.level, self.start, self.stop = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.dim, self.level, self.start, self.stop))

        self.first = np.searchsorted(self.dim, np.arange(dims))  # each dimension's first segment

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best candidates, ties to the smaller id; rows with id own take no part."""
        n, dims = self.vectors.shape
        left = np.arange(n) if own is None else np.nonzero(ids != own)[0]  # rows not proven out
        if not len(left) or k < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        weight = query[self.dim]
        ends = np.stack([weight * (self.level * self.band), weight * (self.level * self.band + self.band - 1)])
        most, impact, sizes = ends.max(axis=0), np.abs(ends).max(axis=0), self.stop - self.start
        level = self._levels(impact, sizes)
        postings = np.bincount(level, sizes, LEVELS)
        # An accumulator holds the sum of what was read, and in its low bits how many dimensions that was.
        shift = dims.bit_length()
        reach = sum(np.maximum.reduceat(impact, self.first).tolist()) + 1 << shift if dims else 0
        total = np.zeros(n, dtype=np.int64 if reach >= 2**31 else np.int32)
        kth, touched = -np.inf, np.zeros(dims, dtype=bool)
        for at in range(LEVELS - 1, -1, -1) if reach < 2**63 else ():
            if len(left) <= k or len(left) * EXACT_COST <= postings[at]:
                break
            segments = np.nonzero(level == at)[0]
            self._read(segments, most, sizes, shift, total)
            touched[self.dim[segments]] = True
            # A row has at most the best that is left of each dimension that nothing was read of, and
            # of the others at most the largest of what is left in as many as it was not found in.
            ahead = level < at
            begun = np.bincount(self.dim[ahead], minlength=dims) > 0
            rest = np.maximum.reduceat(np.where(ahead, most, np.iinfo(most.dtype).min), self.first)
            unread = np.concatenate([[0], np.cumsum(np.sort(rest[begun & touched])[::-1])]) + rest[~touched].sum()
            mine = total[left]
            bound = (mine >> shift) + unread[touched.sum() - (mine & ((1 << shift) - 1))]
            kth = max(kth, self._kth(left, bound, query, k))
            left = left[bound >= kth]
        scores = self._scores(left, query)
        best = np.lexsort((ids[left], -scores))[:k]
        return left[best], scores[best]

    @staticmethod
    def _levels(impact: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each segment's level: the best impacts are in the last, and all levels hold about as many postings."""
        order = np.argsort(-impact, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        level = np.empty(len(impact), dtype=np.int64)
        level[order] = LEVELS - 1 - before * LEVELS // max(1, int(sizes.sum()))
        return level

    def _kth(self, rows: np.ndarray, promise: np.ndarray, query: np.ndarray, k: int) -> float:
        """The k-th best exact score of the most promising of the rows."""
        best = rows[np.argpartition(promise, -4 * k)[-4 * k :]] if len(rows) > 4 * k else rows
        return float(np.sort(self._scores(best, query))[-k]) if len(best) >= k else -np.inf

    def _read(self, segments: np.ndarray, most: np.ndarray, sizes: np.ndarray, shift: int, total: np.ndarray) -> None:
        """Adds segments to the accumulators, those that lie together in a dimension at once."""
        if not len(segments):
            return
        adds = np.repeat(((most[segments] << shift) + 1).astype(total.dtype), sizes[segments])
        parted = (np.diff(segments) > 1) | (np.diff(self.dim[segments]) > 0)
        cuts = np.concatenate([[0], np.nonzero(parted)[0] + 1, [len(segments)]])
        begin = self.start[segments[cuts[:-1]]].tolist()
        end = self.stop[segments[cuts[1:] - 1]].tolist()
        at = 0
        for a, b in zip(begin, end, strict=True):
            total[self.rows[a:b]] += adds[at : at + b - a]
            at += b - a

    def _scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products of the rows alone; floating point where it is exact."""
        if self.floats is not None and np.abs(query).sum() * self.most < self.exact:
            return (self.floats[rows] @ query.astype(self.floats.dtype)).astype(np.int64)
        return self.vectors[rows] @ query


def integer_vectors(column: pa.ChunkedArray, scale: float, dims: int) -> np.ndarray:
    """floor(scale * x) of every component; shorter vectors end in zeros."""
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = np.floor(scale * np.asarray(v, dtype=np.float64))
    return out


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, finite)


def exact_top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 64.0,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), key, score: the k best candidates of each query.

    is_query is a condition on rows. Vectors that are null or hold a null or
    non-finite component, and rows without a key, take no part; vectors of
    unequal length are compared as if filled with zeros. A query with no
    candidate has no rows, one with fewer than k has all. Rows that repeat a
    key are candidates each, but not of their own key; of queries that repeat
    a key, the one with the smallest vector asks."""
    usable = rows.filter(F.col(key).isNotNull() & _usable(F.col(vector)))
    both = usable.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # Numbers of rows deal them evenly, whatever keys or vectors repeat; they hold once they are written.
    both = stored(both.withColumn("row", F.monotonically_increasing_id()))
    asked = both.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    n, n_queries = both.count(), both.filter("q").agg(F.count_distinct("id")).first()[0]
    cands, asks = max(1, -(-n // candidates)), max(1, -(-n_queries // queries))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = both.select("id", "v", F.lit(False).alias("q"), block("row", cands).alias("c"), every(asks).alias("a")).unionByName(
        asked.select("id", "v", F.lit(True).alias("q"), every(cands).alias("c"), block("id", asks).alias("a"))
    )

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by([("q", "ascending"), ("id", "ascending")])
        vectors = group.column("v")
        dims = max((len(v) for v in vectors.to_pylist()), default=0)
        ints = integer_vectors(vectors, scale, dims)
        ids, asked = group.column("id").to_numpy(), group.column("q").to_numpy(zero_copy_only=False)
        index, own = ImpactIndex(ints[~asked]), ids[~asked]
        out = []
        for q, v in zip(ids[asked].tolist(), ints[asked], strict=True):
            found, scores = index.top(v, k, own, q)
            out.append(np.stack([np.full(len(found), q), own[found], scores], axis=1))
        cols = np.concatenate(out).T if out else np.zeros((3, 0), dtype=np.int64)
        return pa.table(dict(zip(("query_id", "id", "score"), cols, strict=True)))

    best = grid.groupBy("c", "a").applyInArrow(search, "query_id long, id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
