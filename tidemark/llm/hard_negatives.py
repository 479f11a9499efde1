"""Operator 11: hard negatives by exact integer scores from a residue number system.

Vectors become integers. A score is an integer inner product, found without
wide arithmetic: both matrices are reduced modulo a few primes so small that a
product of residues is exact in float32, multiplied once for each prime, and the
signed score is put together from its residues by Chinese remaindering in mixed
radix with symmetric digits. As many primes are taken as the largest possible
score (by Cauchy-Schwarz) asks for.

Rows are packed by the thousand into integer matrices. Packs are dealt into
blocks of rows and blocks of anchors, and each pair of blocks is one group of
bounded size, whatever ids, labels or vectors repeat. A first pass over the
pairs multiplies rows and anchors of one label and keeps each anchor's best: its
positives. A second pass keeps, for each anchor and positive, the best rows of
other labels whose scores lie in the positive's window.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.topk import _usable

#: Rows of a pack, of a block of rows, and of a block of anchors; components of a pack at most (but for one row).
PACK, ROWS, ANCHORS, COMPONENTS = 1024, 32768, 32768, 1 << 22
#: Rows and anchors that are multiplied at a time, and dimensions whose products are summed before they are reduced.
TILE_ROWS, TILE_ANCHORS, TILE_DIMS = 8192, 256, 4096
#: Scaled vectors shorter than this have scores that fit a long.
LONGEST = 2.0**31
MOST_TASKS = 4096
LOW = np.iinfo(np.int64).min

PACKED = "ids array<long>, labels array<string>, dims int, kind string, matrix binary, n_positives array<int>, positives array<long>, scores array<long>"


def primes_for(dims: int, largest: int) -> list[int]:
    """Primes, the largest first, whose residues' products sum exactly in float32 over dims, and whose product exceeds 2 * largest."""
    most = 2 * math.isqrt((2**24 - 1) // max(1, min(dims, TILE_DIMS))) + 1
    found, product, n = [], 1, min(most, 4093) | 1
    while product <= 2 * largest:
        if n < 3:
            raise ValueError("too few primes")
        if n <= most and all(n % q for q in range(3, math.isqrt(n) + 1, 2)):
            found.append(n)
            product *= n
        n -= 2
    return found


def symmetric(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo an odd p, between -(p - 1) / 2 and (p - 1) / 2; exact for integers below 2 ** 53."""
    return x - p * np.rint(x / p)


class Residues:
    """An integer matrix (float64) modulo each of the primes, as float32."""

    def __init__(self, matrix: np.ndarray, primes: list[int]):
        self.parts = [symmetric(np.fmod(matrix, p), p).astype(np.float32) for p in primes]

    def rows(self, a: int, b: int) -> list[np.ndarray]:
        return [x[a:b] for x in self.parts]


def exact_products(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """left @ right.T as signed 64-bit integers, from their residues."""
    total, radix, digits = None, 1, []
    wide = math.prod(primes) >= 2**53
    for k, p in enumerate(primes):
        dims = left[k].shape[1]
        found = sum((symmetric((left[k][:, d : d + TILE_DIMS] @ right[k][:, d : d + TILE_DIMS].T).astype(np.float64), p) for d in range(0, dims, TILE_DIMS)), np.zeros((len(left[k]), len(right[k]))))
        for q, digit in zip(primes, digits, strict=False):  # one digit after another is taken off
            found = symmetric(symmetric(found - digit, p) * pow(q, -1, p), p)
        digit = symmetric(found, p)
        digits.append(digit)
        part = digit.astype(np.int64) * radix if wide else digit * radix
        total = part if total is None else total + part
        radix *= p
    return total.astype(np.int64) if total is not None else np.zeros((0, 0), np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores above LOW of each row, best first, ties to the smaller column."""
    n = scores.shape[1]
    kth = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), LOW)
    row, col = np.nonzero((scores >= kth[:, None]) & (scores > LOW))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _integers(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as float64; shorter vectors end in zeros."""
    flat = column.combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(scale * flat.flatten().to_numpy())
    return out


def _smallest_kind(matrix: np.ndarray) -> str:
    most = np.abs(matrix).max(initial=0)
    return next(k for k, top in (("i1", 2**7), ("i2", 2**15), ("i4", 2**31), ("f8", np.inf)) if most < top)


def _packs(rows: DataFrame, scale: float) -> DataFrame:
    """Packs of rows (id, label, v and arrays of their positives' ids and scores)."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            width = max([1, *np.diff(table.column("v").combine_chunks().offsets.to_numpy())]) if table.num_rows else 1
            step = max(1, min(PACK, COMPONENTS // int(width)))
            for at in range(0, table.num_rows, step):
                some = table.slice(at, step)
                matrix = _integers(some.column("v"), scale)
                kind = _smallest_kind(matrix)
                counts = [len(x) for x in some.column("p").to_pylist()]
                flat = [sum(some.column(c).to_pylist(), []) for c in ("p", "s")]
                row = [some.column("id").to_pylist(), some.column("label").to_pylist(), matrix.shape[1], kind, matrix.astype(kind).tobytes(), counts, *flat]
                names = [x.split()[0] for x in PACKED.split(", ")]
                types = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return rows.select("id", "label", "v", "p", "s").mapInArrow(pack, PACKED)


class Block:
    """The rows of one width of some packs, by ascending id."""

    def __init__(self, packs: list[dict], dims: int):
        self.ids = np.concatenate([np.array(p["ids"], np.int64) for p in packs])
        self.labels = np.array([x for p in packs for x in p["labels"]], dtype=object)
        matrix = np.concatenate([np.frombuffer(p["matrix"], p["kind"]).reshape(len(p["ids"]), dims) for p in packs]).astype(np.float64)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.labels, self.matrix = self.ids[order], self.labels[order], matrix[order]
        self.longest = math.isqrt(int(np.max((matrix**2).sum(axis=1), initial=0)) + 1) + 1
        counts = [n for p in packs for n in p["n_positives"]]
        cuts = np.concatenate([[0], np.cumsum(counts)]).astype(int)
        flat = [(i, s) for p in packs for i, s in zip(p["positives"], p["scores"], strict=True)]
        self.positives = [flat[cuts[i] : cuts[i + 1]] for i in order]


def _blocks(packs: list[dict]) -> list[Block]:
    return [Block([p for p in packs if p["dims"] == d], d) for d in sorted({p["dims"] for p in packs})]


def _tiles(rows: Block, anchors: Block, r: np.ndarray, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, anchors and their scores (anchors by rows), tile by tile, of the picked ones."""
    dims = min(rows.matrix.shape[1], anchors.matrix.shape[1])
    primes = primes_for(dims, rows.longest * anchors.longest)
    left = Residues(anchors.matrix[a, :dims], primes)
    for i in range(0, len(r), TILE_ROWS):
        mine = r[i : i + TILE_ROWS]
        right = Residues(rows.matrix[mine, :dims], primes).parts
        for j in range(0, len(a), TILE_ANCHORS):
            yield mine, a[j : j + TILE_ANCHORS], exact_products(left.rows(j, j + TILE_ANCHORS), right, primes)


def _codes(*labels: np.ndarray) -> list[np.ndarray]:
    every = {x: i for i, x in enumerate(dict.fromkeys(x for some in labels for x in some))}
    return [np.array([every[x] for x in some], dtype=np.int64) for some in labels]


def nearest_of_label(rows: Block, anchors: Block, k: int) -> Iterator[tuple]:
    """anchor, row, score of the k best other rows of each anchor's label."""
    own, asked = _codes(rows.labels, anchors.labels)
    by_row, by_anchor = np.argsort(own, kind="stable"), np.argsort(asked, kind="stable")
    for label in np.unique(asked):
        r = by_row[np.searchsorted(own[by_row], label) : np.searchsorted(own[by_row], label, "right")]
        a = by_anchor[np.searchsorted(asked[by_anchor], label) : np.searchsorted(asked[by_anchor], label, "right")]
        for mine, some, scores in _tiles(rows, anchors, r, a) if len(r) else ():
            scores[anchors.ids[some][:, None] == rows.ids[mine]] = LOW
            i, j = best(scores, k)
            yield anchors.ids[some[i]], rows.ids[mine[j]], scores[i, j]


def in_windows(rows: Block, anchors: Block, k: int, low: int, high: int) -> Iterator[tuple]:
    """anchor, place of the positive, its id and score, row, score: the k best rows of other labels in each positive's window."""
    own, asked = _codes(rows.labels, anchors.labels)
    for mine, some, scores in _tiles(rows, anchors, np.arange(len(own)), np.arange(len(asked))):
        other = asked[some][:, None] != own[mine]
        for place in range(max((len(anchors.positives[a]) for a in some), default=0)):
            having = np.array([i for i, a in enumerate(some) if len(anchors.positives[a]) > place])
            found = [anchors.positives[some[i]][place] for i in having]
            # Bounds of integers, with the percentages cleared.
            least = np.array([-(-low * s // 100) for _, s in found])[:, None]
            most = np.array([high * s // 100 for _, s in found])[:, None]
            part = scores[having]
            i, j = best(np.where(other[having] & (part >= least) & (part <= most), part, LOW), k)
            ids, values = (np.array([x[n] for x in found], np.int64)[i] for n in (0, 1))
            yield anchors.ids[some[having[i]]], np.full(len(i), place + 1), ids, values, rows.ids[mine[j]], part[i, j]


def _pairs(rows: DataFrame, anchors: DataFrame, work, schema: str) -> DataFrame:
    """The union of work(rows' block, anchors' block) over all pairs of blocks of the packs."""
    spark = rows.sparkSession
    count = lambda packs: packs.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.count("*")).first()
    (n, n_packs), (m, _) = count(rows), count(anchors)
    # Small tables are cut finer, so that all cores have work.
    cuts = max(-(-n // ROWS), min(n_packs, 4 * spark.sparkContext.defaultParallelism), 1), max(-(-m // ANCHORS), 1)
    dealt = lambda n: F.pmod(F.xxhash64("matrix", "ids"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = rows.select("*", F.lit(False).alias("asks"), dealt(cuts[0]).alias("c")).withColumn("a", every(cuts[1])).unionByName(
        anchors.select("*", F.lit(True).alias("asks"), dealt(cuts[1]).alias("a")).withColumn("c", every(cuts[0]))
    )
    names = [x.split()[0] for x in schema.split(", ")]

    def group(table: pa.Table) -> pa.Table:
        packs = table.to_pylist()
        mine, asked = (_blocks([p for p in packs if p["asks"] == asks]) for asks in (False, True))
        found = [np.stack(x) for r in mine for a in asked for x in work(r, a)]
        cols = np.concatenate(found, axis=1) if found else np.zeros((len(names), 0), np.int64)
        return pa.table(dict(zip(names, cols, strict=True)))

    return grid.repartition(min(4 * cuts[0] * cuts[1], MOST_TASKS), "c", "a").groupBy("c", "a").applyInArrow(group, schema)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    *,
    key: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    is_anchor is a condition on rows. An anchor's positives are its first other
    rows of its label by descending score, ties to the smaller key; a positive's
    negatives are the first rows of other labels that score between low and high
    percent of the positive's score, both included.

    Rows without a key or label take no part, nor do those whose vector is null,
    holds a null or a non-finite component, or is LONGEST or more once scaled
    (its scores might not fit a long). Vectors of unequal length are compared as
    if filled with zeros. Rows that repeat a key are candidates each, but not of
    their own key; of anchors that repeat a key, the one that comes first by
    label and vector asks. An anchor without a positive, and a positive without
    a negative in its window, have no rows. No rows give none."""
    name = F.col(label) if isinstance(label, str) else label
    asks = F.coalesce(is_anchor, F.lit(False))
    used = rows.filter(F.col(key).isNotNull() & name.isNotNull() & _usable(F.col(vector)))
    used = used.select(F.col(key).cast("long").alias("id"), name.cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"), asks.alias("asks"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x * scale) * (x * scale))
    used = used.filter(length < LONGEST**2)
    none = F.array().cast("array<long>")
    packed = stored(_packs(used.withColumns({"p": none, "s": none}), scale))
    asked = used.filter("asks").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
    anchors = stored(_packs(asked.withColumns({"p": none, "s": none}), scale))

    near = _pairs(packed, anchors, lambda r, a: nearest_of_label(r, a, positives), "anchor_id long, id long, score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("l"))
    asked = asked.join(lists.select(F.col("anchor_id").alias("id"), F.col("l.id").alias("p"), F.col("l.score").alias("s")), "id")
    anchors = stored(_packs(asked, scale))

    schema = "anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _pairs(packed, anchors, lambda r, a: in_windows(r, a, negatives, low, high), schema)
    order = W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 10
"""
