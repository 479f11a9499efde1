"""Operator 1: SimHash near-duplicates found through the anchors of a covering code.

Two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit
of their upper or of their lower half. In each half the anchors are a covering
code of 32 bits: the perfect Hamming code of length 31 (covering radius 1) and
one free bit. A half is replicated to every anchor within covering radius plus
the half's threshold, 1 + 1 = 2: the anchor nearest to one fingerprint is
within 2 of the other, so every linked pair meets at an anchor. That makes at
most 17 anchors a half, 34 keys of 27 bits a fingerprint. (A code over all 64
bits would need some 10,000 replicas at radius 1 + 3.)

Equal fingerprints are one before they are replicated. An anchor's
fingerprints are compared in blocks and only a spanning forest of their links
leaves a task. Crowded anchors are dealt into cells that each compare two parts
of bounded size, so no task gets more than two parts of one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored, unused
from tidemark.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of an anchor that one part of a crowded anchor holds.
PART = 2048

_LANES = np.uint64(0x0101010101010101)
_SHIFTS = np.arange(8, dtype=np.uint64)[:, None]


def text_fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text: A-Z lowered, shingles of words with repeats."""
    words = text.lower().split()  # for bytes: ASCII case and white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    counts = np.zeros((8, 8), dtype=np.int64)  # bit within a byte, byte
    for at in range(0, len(hashes), 255):  # eight counters of a byte in each word
        lanes = ((hashes[at : at + 255] >> _SHIFTS) & _LANES).sum(axis=1, dtype=np.uint64)
        counts += lanes.view(np.uint8).reshape(8, 8)
    bits = (2 * counts > len(hashes)).T.ravel()  # byte by byte, lowest bit first
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, also: Sequence[str] = ()) -> DataFrame:
    """key, fp (long with the fingerprint's 64 bits) and the columns also, of every row.

    A null text counts as empty; an empty text has fingerprint 0. Other columns
    are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            found = [text_fingerprint(t or b"", shingle, seed) for t in part.column(1).to_pylist()]
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), prints, *part.columns[2:]], names=["key", "fp", *names])

    names = [f"c{i}" for i in range(len(also))]
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, also, strict=True)]
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), *[F.col(c).alias(n) for n, c in zip(names, also, strict=True)])
    found = picked.mapInArrow(run, ", ".join([f"key {docs.schema[key].dataType.simpleString()}", "fp long", *kinds]))
    return found.toDF(key, "fp", *also)


def half_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within 2 of each 32-bit half.

    Bits 0-30 belong to the Hamming code: the xor of the numbers (1-31) of set
    bits is the syndrome, 0 for a code word. Bit 31 is free."""
    half = half.astype(np.uint64)
    code, free = half & np.uint64(0x7FFFFFFF), half >> np.uint64(31)
    number = np.arange(1, 32)
    syndrome = np.zeros(len(half), dtype=np.int64)
    for n in number.tolist():
        syndrome ^= np.where((code >> np.uint64(n - 1)) & np.uint64(1) == 1, n, 0)
    flip = np.concatenate([[0], 1 << (number - 1)]).astype(np.uint64)  # by bit number; 0 flips nothing
    rows, anchors = [], []

    def add(row: np.ndarray, words: np.ndarray, bit: np.ndarray) -> None:
        rows.append(row)
        anchors.append(words | bit << np.uint64(31))

    every = np.arange(len(half))
    nearest = code ^ flip[syndrome]  # at distance 0 or 1
    add(every, nearest, free)
    add(every, nearest, free ^ np.uint64(1))
    for n in number.tolist():  # two flips i < j with i ^ j = syndrome
        other = syndrome ^ n
        row = np.nonzero((syndrome > 0) & (other > n))[0]
        add(row, code[row] ^ flip[n] ^ flip[other[row]], free[row])
    return np.concatenate(rows), np.concatenate(anchors)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 8192):
        fp = part.column(0).to_numpy().view(np.uint64)
        for side in (0, 1):
            row, anchor = half_anchors(fp >> np.uint64(32) if side else fp & np.uint64(0xFFFFFFFF))
            keys = anchor.astype(np.int64) << 1 | side
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[row].view(np.int64))], names=["anchor", "fp"])


class Forest:
    """Union-find over the fingerprints of one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while (nxt := up.get(x, x)) != top:
            up[x], x = top, nxt
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def links(self) -> tuple[list[int], list[int]]:
        pairs = [(x, self.root(x)) for x in list(self.up)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return [x for x, _ in pairs], [r for _, r in pairs]


def link_within(fp: np.ndarray, part: np.ndarray, distance: int, forest: Forest) -> None:
    """Links of fingerprints at most distance apart; with two parts, those between them and within each."""
    for at in range(0, len(fp), 256):
        own = fp[at : at + 256]
        near = np.bitwise_count(own[:, None] ^ fp[None, at:]) <= distance
        a, b = np.nonzero(near)
        keep = a < b
        for x, y in zip(own[a[keep]].tolist(), fp[at:][b[keep]].tolist(), strict=True):
            forest.link(x, y)


def linked(prints: DataFrame, *, distance: int = DISTANCE, part: int = PART) -> DataFrame:
    """a, b: a forest of links that joins exactly the distinct fp that chains of links join."""
    if distance > 3:
        raise ValueError("the anchors cover up to 3 differing bits")
    replicas = prints.select("fp").distinct().mapInArrow(_replicate, "anchor long, fp long")
    replicas = stored(replicas)
    crowd = replicas.groupBy("anchor").count().filter(F.col("count") > 1)
    # Anchors of one fingerprint link nothing. A crowded one is cut into k parts by a hash; a
    # fingerprint of part i goes to the cells (i, j) and (j, i) of all j.
    sized = replicas.join(crowd, "anchor").withColumn("k", F.ceil(F.col("count") / F.lit(part)).cast("int"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    cells = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "anchor", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, at = Forest(), [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("anchor", "i", "j")], axis=1)
            fp = batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1, [len(fp)]])
            if len(fp) and at is not None and tuple(keys[0].tolist()) != at:
                _close(held, distance, forest)
                held = []
            ends = cuts[1:-1].tolist()
            if ends:
                held.append(fp[: ends[0]])
                _close(held, distance, forest)
                _close_many(fp, ends, distance, forest)
                held = [fp[ends[-1] :]]
            elif len(fp):
                held.append(fp)
            if len(fp):
                at = tuple(keys[-1].tolist())
        _close(held, distance, forest)
        a, b = forest.links()
        kind = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
        for start in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([kind(a[start : start + 50_000]), kind(b[start : start + 50_000])], names=["a", "b"])

    together = cells.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")
    return together.mapInArrow(compare, "a long, b long")


def _close(held: list[np.ndarray], distance: int, forest: Forest) -> None:
    if held and sum(map(len, held)) > 1:
        fp = np.concatenate(held)
        link_within(fp, fp, distance, forest)


def _close_many(fp: np.ndarray, ends: list[int], distance: int, forest: Forest) -> None:
    """The cells between ends; small ones are compared together, by the distance of their rows."""
    starts, stops = np.array(ends[:-1], dtype=np.int64), np.array(ends[1:], dtype=np.int64)
    sizes = stops - starts
    small = sizes <= 32
    for a, b in zip(starts[~small].tolist(), stops[~small].tolist(), strict=True):
        link_within(fp[a:b], fp[a:b], distance, forest)
    if not small.any():
        return
    stop_of = np.repeat(stops[small], sizes[small])
    row = np.repeat(starts[small] - (np.cumsum(sizes[small]) - sizes[small]), sizes[small]) + np.arange(sizes[small].sum())
    for lag in range(1, int(sizes[small].max())):
        keep = row + lag < stop_of
        row, stop_of = row[keep], stop_of[keep]
        near = np.bitwise_count(fp[row] ^ fp[row + lag]) <= distance
        for x, y in zip(fp[row[near]].tolist(), fp[row[near] + lag].tolist(), strict=True):
            forest.link(x, y)


def _rooted(docs: DataFrame, key: str, text: str, shingle: int, seed: int, distance: int, also: list[str]) -> DataFrame:
    """key, fp, root (one fingerprint of the group), component_id and the columns also, of every row."""
    prints = stored(fingerprints(docs, key=key, text=text, shingle=shingle, seed=seed, also=also))
    roots = components(linked(prints, distance=distance))
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted)
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(groups, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """key, fp and component_id (the smallest key that chains of links reach) of every row.

    Rows with equal fingerprints are linked: repeated rows, and all null or
    empty texts. An empty table gives no rows; null keys stay null and count
    for component_id only if no other key is there."""
    return _rooted(docs, key, text, shingle, seed, distance, []).select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest key; columns as in docs.

    Documents are told apart by key and text together: rows of one key with unlike
    texts are in different groups, and each group keeps one of its own. Of a group
    whose smallest key has several texts, the one with the smallest hash stays; of
    rows equal in key and text, one. Rows without a key belong to no group and stay."""
    tag = unused(docs, "_text_sha")
    tagged = docs.withColumn(tag, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    found = _rooted(tagged.filter(F.col(key).isNotNull()), key, text, shingle, seed, distance, [tag])
    keep = found.filter(F.col(key) == F.col("component_id")).groupBy("root").agg(F.first(key).alias(key), F.min(tag).alias(tag)).drop("root")
    chosen = tagged.join(keep, [key, tag], "left_semi").dropDuplicates([key, tag])
    return chosen.select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))
