"""Operator 6: quality scores by a factorisation machine.

A document's features are its hashed words, binned structure statistics and
binned numeric metadata. The model has a weight and a vector of low rank for
each feature; the sum over all pairs of features of their vectors' products is
half of the square of the sum less the sum of squares, so scoring takes time
linear in the features. The model is fitted on a bounded sample of labelled
documents and shipped to the tasks, which score whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices
from tidemark.llm.words import WordTable, sums_by_text

#: Hash buckets of words, bins of a statistic, rank of the pair weights.
BUCKETS, BINS, RANK = 1 << 15, 10, 8
#: Labelled documents to fit on, at most (those with the lowest hash), and passes over them.
SAMPLE_DOCS, EPOCHS = 8000, 12
BATCH, RATE, DECAY, SEED = 128, 0.02, 1e-6, 6

#: What is kept of a word beside its bucket.
_SYMBOLS = frozenset("#*$%&|<>{}[]\\^~_=+@")
_TRAITS = 6
#: Statistics of a text, each from 0 to 1; every one has BINS features, and one more for "absent".
STATISTICS = ("length", "upper words", "symbol words", "shouted words", "lone bars", "words with digits", "repeats of the word before", "distinct words", "word length", "lines", "lines without an end", "repeated lines")
_ENDS = tuple(".!?…:;\"'”»)")


def describe(words: list[str]) -> np.ndarray:
    """Bucket, upper case, symbols, doubled exclamation mark, lone bar, digits, length of each word."""
    out = np.zeros((len(words), _TRAITS + 1), dtype=np.int32)
    for row, w in zip(out, words, strict=True):
        row[0] = zlib.crc32(w.lower().encode()) % BUCKETS
        row[6] = min(len(w), 40)
        if w.isalpha():
            row[1] = len(w) > 1 and w.isupper()
            continue
        row[1] = len(w) > 1 and w.isupper()
        row[2] = not _SYMBOLS.isdisjoint(w)
        row[3] = "!!" in w
        row[4] = w in ("|", ">", "»", "•")
        row[5] = any(c.isdigit() for c in w)
    return out


def text_statistics(text: str, words: np.ndarray) -> list[float]:
    """The STATISTICS of one text; words are its rows of describe."""
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    lines = [x for x in text.split("\n") if x.strip()]
    share = words[:, 1:6].sum(axis=0) / n
    bucket = words[:, 0]
    return [
        min(1.0, np.log2(1 + n) / 16),
        *share.tolist(),
        float((bucket[1:] == bucket[:-1]).mean()) if n > 1 else 0.0,
        len(np.unique(bucket)) / n,
        float(words[:, 6].mean()) / 40,
        min(1.0, np.log2(1 + len(lines)) / 12),
        sum(not x.rstrip().endswith(_ENDS) for x in lines) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
    ]


def feature_rows(texts: list[str], metadata: np.ndarray, table: WordTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of texts in three arrays: text number, feature number, value; ordered by the first two.

    A word's value is the log of its count; all words of a text have norm 1
    together. Bins count half. metadata has a row of numbers (or NaN) for each
    text; a number's bin is that of its logarithm."""
    values, ends = table.look_up(texts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    doc = np.repeat(np.arange(len(texts)), ends - starts)
    keys, counts = np.unique(doc * BUCKETS + values[:, 0], return_counts=True)
    d, x = keys // BUCKETS, np.log1p(counts)
    norm = np.sqrt(np.bincount(d, x * x, minlength=len(texts)))
    stats = np.array([text_statistics(t, values[a:b]) for t, a, b in zip(texts, starts, ends, strict=True)]).reshape(len(texts), -1)
    meta = np.log2(1 + np.abs(metadata)) / 40
    both = np.concatenate([stats, meta], axis=1)
    bins = np.where(np.isnan(both), BINS, np.minimum(np.floor(np.nan_to_num(both) * BINS), BINS - 1)).astype(np.int64)
    # A share of exactly 0 differs from a small one.
    bins = np.where(both == 0, 0, np.where(bins == 0, 1, bins))
    columns = both.shape[1]
    number = BUCKETS + np.arange(columns) * (BINS + 1) + bins
    row = np.concatenate([d, np.repeat(np.arange(len(texts)), columns)])
    feature = np.concatenate([keys % BUCKETS, number.ravel()])
    value = np.concatenate([x / np.maximum(norm[d], 1e-12), np.full(number.size, 0.5)])
    order = np.lexsort((feature, row))
    return row[order], feature[order], value[order]


class FactorisationMachine:
    """Bias, weights and low-rank vectors."""

    def __init__(self, features: int, rank: int = RANK, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bias, self.weight = 0.0, np.zeros(features)
        self.vectors = rng.normal(0, 0.05, (features, rank))

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """The log odds of n texts."""
        ends = np.cumsum(np.bincount(row, minlength=n))
        scaled = self.vectors[feature] * value[:, None]
        square = sums_by_text(scaled, ends) ** 2
        return self.bias + sums_by_text(self.weight[feature] * value, ends) + 0.5 * (square.sum(axis=1) - sums_by_text((scaled**2).sum(axis=1), ends))

    def score(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(row, feature, value, n), -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> FactorisationMachine:
        """Adam on the logistic loss; rows are (features, values) of each text."""
        labels = np.asarray(labels, dtype=np.float64)
        share = (labels.sum() + 1) / (len(labels) + 2)
        self.bias = float(np.log(share / (1 - share)))
        rng, steps = np.random.default_rng(seed), 0
        size = len(self.weight)
        params = np.concatenate([self.weight[:, None], self.vectors], axis=1)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for _ in range(epochs if len(rows) else 0):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH].tolist()
                row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
                feature, value = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
                self.weight, self.vectors = params[:, 0], params[:, 1:]
                error = self.score(row, feature, value, len(part)) - labels[part]
                ends = np.cumsum(np.bincount(row, minlength=len(part)))
                scaled = self.vectors[feature] * value[:, None]
                pull = (sums_by_text(scaled, ends)[row] - scaled) * value[:, None] * error[row, None]
                grad = np.stack([np.bincount(feature, g, size) for g in (value * error[row], *pull.T)], axis=1) / len(part) + DECAY * params
                steps += 1
                m = 0.9 * m + 0.1 * grad
                v = 0.999 * v + 0.001 * grad * grad
                params = params - RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
                self.bias -= RATE * float(error.mean())
        self.weight, self.vectors = params[:, 0].copy(), params[:, 1:].copy()
        return self


_TABLE: list[WordTable] = []


def _table() -> WordTable:
    if not _TABLE:
        _TABLE.append(WordTable(describe, 400_000))
    return _TABLE[0]


def _metadata(part: pa.RecordBatch, first: int) -> np.ndarray:
    columns = [part.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(first, part.num_columns)]
    return np.stack(columns, axis=1) if columns else np.zeros((part.num_rows, 0))


def _picked(docs: DataFrame, key: str, text: str, metadata: list[str]) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])


def train(
    docs: DataFrame, labels: DataFrame, label: str, *, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = (), sample: int = SAMPLE_DOCS
) -> FactorisationMachine:
    """A machine fitted to the texts of at most sample rows of labels (key, label), a label of 1 being good.

    The sample is drawn from the labels, so its size bounds what is broadcast
    to find the texts. Rows without a key or a label are left out, null texts
    count as empty, null metadata has a bin of its own. Without labelled texts
    all scores are near 0.5."""
    metadata = list(metadata)
    chosen = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).dropna()
    chosen = chosen.orderBy(F.xxhash64("key", F.lit(6)), "key", "y").limit(sample)
    rows = _picked(docs, key, text, metadata).join(F.broadcast(chosen), "key").select("key", "text", "y", *[f"m{i}" for i in range(len(metadata))])

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 128):
            texts = [t or "" for t in part.column(1).to_pylist()]
            row, feature, value = feature_rows(texts, _metadata(part, 3), _table())
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]), pa.int32())
            columns = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (feature.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([pa.array(part.column(0).cast(pa.string())), *columns, part.column(2)], names=["key", "feature", "value", "y"])

    # A key that repeats brings all its rows; the first sample of them reach the driver, of at most a feature for each bucket.
    made = rows.mapInArrow(featurise, "key string, feature array<int>, value array<double>, y double")
    found = made.orderBy("key", "y", "feature", "value").limit(sample).toArrow()
    # As arrays, never as Python numbers, which would take the driver ten times the memory.
    lists = [found.column(i).combine_chunks() for i in (1, 2)]
    cuts = lists[0].offsets.to_numpy().tolist()
    feature, value = (x.values.to_numpy() for x in lists)
    pairs = [(feature[a:b], value[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    machine = FactorisationMachine(BUCKETS + (len(STATISTICS) + len(metadata)) * (BINS + 1))
    return machine.fit(pairs, found.column(3).to_numpy())


def score(docs: DataFrame, machine: FactorisationMachine, *, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """key and score (0 to 1) of every row of docs; metadata as in train.

    Null and empty texts are scored by their statistics and metadata; repeated
    rows get equal scores; an empty table gives none; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, 128):
            texts = [t or "" for t in part.column(1).to_pylist()]
            found = own.score(*feature_rows(texts, _metadata(part, 2), _table()), len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return _picked(docs, key, text, list(metadata)).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def with_score(docs: DataFrame, machine: FactorisationMachine, *, text: str = "text", metadata: tuple[str, ...] = (), score: str = "_score") -> DataFrame:
    """docs with a score column, in one pass; whatever the columns are called."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *[docs[c].cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, 128):
            texts = [t or "" for t in part.column(0).flatten()[at].to_pylist()]
            found = own.score(*feature_rows(texts, _metadata(part, 1), _table()), len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["row", "score"])

    kind = packed.schema["row"].dataType.simpleString()
    scored = packed.mapInArrow(run, f"row {kind}, score double")
    return scored.select(*[F.col("row")[c].alias(c) for c in names], F.col("score").alias(score))
