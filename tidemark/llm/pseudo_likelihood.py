"""Operator 3: documents scored by masked pseudo-likelihood.

A small network sees the words on both sides of a masked word, in a window, and
predicts the word. The corpus's most frequent words, thousands of them, are
classes of their own; all others are told apart in three steps, the last of
which doesn't look at the window: a class for their shape (length and kind),
and the word's share in that class. Classes lie in groups in the order of
their frequency; the softmax has two levels, the group and the class in its
group, and is exact in training and scoring. A document's score is the sum of
the log-probabilities of its words, each predicted from both sides.

The shares come from the counts of all words of all documents, a Spark table
that grows with them: those of at most KNOWN frequent words go to the tasks,
all others are joined. A word that was not counted has the share of one more
word in its class, parted over all spellings.

Word counts cover all documents and give the classes and the output layers'
biases, the logs of the groups' and classes' shares of the corpus. The weights
are trained on all documents: each partition trains a copy on all of its own,
and the copies are averaged by words. The copies start from a fit to a bounded
sample of documents, so that they can be averaged.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, slices, stored
from tidemark.llm.words import WordTable, ascii_words, sums_by_text

#: Frequent words with a class of their own; words on each side; sizes of the layers.
FREQUENT, WINDOW, EMBED, HIDDEN = 4048, 2, 16, 32
#: Classes of a group of the two-level softmax.
GROUP = 64
#: Shapes: up to 12 characters by letters in lower case, letters, with digits, other.
LENGTHS, KINDS = 12, 4
#: Words whose shares are sent to the tasks at most.
KNOWN = 100_000
#: Words that a partition trains on at a time.
CHUNK = 400_000
SAMPLE_DOCS, EPOCHS, RATE, SEED = 2000, 2, 0.01, 3
#: Words of a step: a forty-eighth of those at hand, between these.
STEPS, FEWEST, BATCH = 48, 512, 8192
#: Weights that are moved at a time, which a processor's cache holds with their moments.
PART = 1 << 15
#: Weights of a row when copies are averaged.
PACK = 4096


def shape(word: str) -> int:
    kind = (0 if word.islower() else 1) if word.isalpha() else 2 if any(c.isdigit() for c in word) else 3
    return min(len(word), LENGTHS) - 1 + LENGTHS * kind


class Classes:
    """The classes of words: frequent ones first, then shapes; one more stands for "no word"."""

    def __init__(self, frequent: list[str]):
        self.number = {w: i for i, w in enumerate(frequent)}
        self.size = len(frequent) + LENGTHS * KINDS
        self.total = np.ones(self.size)  # words of each class in the corpus, and one
        self.kind = np.int16 if self.size < 1 << 15 else np.int32  # holds a class's number, and that of "no word"

    def of(self, words: list[str]) -> np.ndarray:
        own, base = self.number, len(self.number)
        return np.array([own[w] if w in own else base + shape(w) if w else 0 for w in words], dtype=np.int32)


def windows(classes: np.ndarray, ends: np.ndarray, nothing: int, window: int = WINDOW) -> np.ndarray:
    """The classes on both sides of every word (a column for each place); texts don't see each other."""
    out = np.full((len(classes), 2 * window), nothing, dtype=classes.dtype)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    for k in range(1, window + 1):
        same = text[k:] == text[:-k]
        out[k:, window - k][same] = classes[:-k][same]
        out[:-k, window + k - 1][same] = classes[k:][same]
    return out


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


#: Sums of weights of hidden values (-1 to 1) up to this, with biases that are logs of shares, have exponentials without a shift.
PLAIN = 50.0


_SPACE: dict[str, np.ndarray] = {}


def _space(name: str, rows: int, width: int, kind: np.dtype) -> np.ndarray:
    """An array to be filled, kept for the next call: pages that are new each time took a sixth of the time of training."""
    have = _SPACE.get(name)
    if have is None or len(have) < rows or have.shape[1] != width or have.dtype != kind:
        have = _SPACE[name] = np.empty((max(rows, BATCH), width), kind)
    return have[:rows]


def _exponentials(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, plain: bool, out: np.ndarray) -> None:
    """What the softmax is in proportion to; without a shift of rows if all logits are small."""
    np.matmul(h, weights, out=out)
    out += bias
    if not plain:
        out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)


def _adam(p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, step: int) -> None:
    """Moves p by the moments m and v of its gradient g, in place (g too)."""
    m *= 0.9
    move = g * 0.1
    m += move
    g *= g
    g *= 0.001
    v *= 0.999
    v += g
    np.sqrt(v, out=move)
    unbiased = (1 - 0.999**step) ** 0.5
    move += 1e-8 * unbiased
    np.divide(m, move, out=move)
    move *= RATE * unbiased / (1 - 0.9**step)
    p -= move


def _order(numbers: np.ndarray) -> np.ndarray:
    """The stable order of numbers; numpy sorts short ones by radix."""
    small = not len(numbers) or numbers.max() < 1 << 15
    return np.argsort(numbers.astype(np.int16, copy=False) if small else numbers, kind="stable")


def _firsts(numbers: np.ndarray) -> np.ndarray:
    """Where each number begins, of numbers in order."""
    return np.concatenate([[0], np.flatnonzero(numbers[1:] != numbers[:-1]) + 1]) if len(numbers) else np.zeros(0, np.int64)


class WindowNetwork:
    """Embedding, one hidden layer over the concatenated window, softmax over groups and over a group's classes."""

    def __init__(self, classes: Classes, share: np.ndarray, window: int = WINDOW, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes, self.window = classes, window
        groups = -(-classes.size // GROUP)
        self.embed = rng.normal(0, 0.3, (classes.size + 1, EMBED)).astype(np.float32)
        self.inner = rng.normal(0, 0.1, (2 * window, EMBED, HIDDEN)).astype(np.float32)
        self.inner_bias = np.zeros(HIDDEN, dtype=np.float32)
        self.group = rng.normal(0, 0.05, (HIDDEN, groups)).astype(np.float32)
        self.own = rng.normal(0, 0.05, (groups, HIDDEN, GROUP)).astype(np.float32)
        shares = np.zeros(groups * GROUP)
        shares[: classes.size] = share
        shares = shares.reshape(groups, GROUP)
        self.group_bias = np.log(shares.sum(axis=1)).astype(np.float32)
        self.own_bias = np.log(np.maximum(shares, 1e-30) / shares.sum(axis=1, keepdims=True)).astype(np.float32)  # places without a class: next to nothing
        self.own[np.arange(groups * GROUP).reshape(groups, 1, GROUP).repeat(HIDDEN, 1) >= classes.size] = 0

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return self._hidden(self._seen(context)).copy()

    def _seen(self, context: np.ndarray) -> np.ndarray:
        """The embeddings at all places, side by side."""
        out = _space("seen", len(context), 2 * self.window * EMBED, self.embed.dtype)
        np.take(self.embed, context, axis=0, out=out.reshape(len(context), 2 * self.window, EMBED), mode="clip")
        return out

    def _hidden(self, seen: np.ndarray) -> np.ndarray:
        total = np.matmul(seen, self.inner.reshape(-1, HIDDEN), out=_space("hidden", len(seen), HIDDEN, seen.dtype))
        total += self.inner_bias
        return np.tanh(total, out=total)

    def _plain(self) -> bool:
        return max(np.abs(self.group).sum(axis=0).max(), np.abs(self.own).sum(axis=1).max()) <= PLAIN

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The log-probability of each target in its context."""
        out, plain, every = np.empty(len(target), dtype=np.float32), self._plain(), np.arange(2 * BATCH)

        def chosen(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
            if not plain:
                return _log_softmax(h @ weights + bias)[every[: len(at)], at]
            e = _space("own", len(h), weights.shape[1], h.dtype)
            _exponentials(h, weights, bias, plain, e)
            return np.log(e[every[: len(at)], at] / (e @ np.ones(e.shape[1], e.dtype)))

        for begin in range(0, len(target), 2 * BATCH):
            rows = begin + _order(target[begin : begin + 2 * BATCH])  # a group's words lie together
            goal, h = target[rows], self._hidden(self._seen(context[rows]))
            group, place, logs = goal // GROUP, goal % GROUP, np.zeros(len(rows), h.dtype)
            for at in range(0, len(rows), 1024):
                part = slice(at, at + 1024)
                logs[part] = chosen(h[part], self.group, self.group_bias, group[part])
            for g, part in _runs(group):
                logs[part] += chosen(h[part], self.own[g], self.own_bias[g], place[part])
            out[rows] = logs
        return out

    def weights(self) -> list[np.ndarray]:
        """What is trained; the biases of the output are counted."""
        return [self.embed, self.inner, self.inner_bias, self.group, self.own]

    def fit(self, classes: np.ndarray, ends: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, state: dict | None = None) -> WindowNetwork:
        """Adam on the cross-entropy of every word of the texts, masked one at a time. A state carries the moments on to the next call."""
        context = windows(classes, ends, self.classes.size, self.window)
        rng = np.random.default_rng(seed)
        params = self.weights()
        state = {} if state is None else state
        first, second = (state.setdefault(k, [np.zeros_like(p) for p in params]) for k in ("first", "second"))
        step = state.get("step", 0)
        size = max(FEWEST, min(BATCH, len(classes) // STEPS))
        for _ in range(epochs if len(classes) else 0):
            order = rng.permutation(len(classes))
            for at in range(0, len(order), size):
                rows = order[at : at + size]
                rows = rows[_order(classes[rows])]  # a group's words lie together
                step += 1
                for p, m, v, g in zip(params, first, second, self._gradients(context[rows], classes[rows]), strict=True):
                    flat = [x.reshape(-1) for x in (p, m, v, g)]
                    for cut in range(0, p.size, PART):
                        _adam(*(x[cut : cut + PART] for x in flat), step)
        state["step"] = step
        return self

    def _gradients(self, context: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the mean loss by each of the weights; goals in order."""
        seen, n, group = self._seen(context), len(goal), goal // GROUP
        h, runs, every = self._hidden(seen), _runs(group), np.arange(len(goal))
        plain, (groups, own_e) = self._plain(), (_space(k, n, w, h.dtype) for k, w in (("groups", self.group.shape[1]), ("own", GROUP)))
        _exponentials(h, self.group, self.group_bias, plain, groups)
        for g, part in runs:
            _exponentials(h[part], self.own[g], self.own_bias[g], plain, own_e[part])

        def scale(e: np.ndarray, at: np.ndarray) -> np.ndarray:
            """One taken from the goal's probability; what each row is still to be multiplied by (put to the narrow factors)."""
            total = e @ np.ones(e.shape[1], e.dtype)
            e[every, at] -= total
            total *= n
            return np.reciprocal(total)[:, None]

        back, more, scaled = (_space(k, n, HIDDEN, h.dtype) for k in ("back", "more", "scaled"))
        by_row = scale(groups, group)
        np.matmul(groups, self.group.T, out=back)
        back *= by_row
        by_group = np.multiply(h, by_row, out=scaled).T @ groups
        by_row, own = scale(own_e, goal % GROUP), np.zeros_like(self.own)
        np.multiply(h, by_row, out=scaled)
        for g, part in runs:
            np.matmul(own_e[part], self.own[g].T, out=more[part])
            np.matmul(scaled[part].T, own_e[part], out=own[g])
        more *= by_row
        back += more
        h *= h
        np.subtract(1, h, out=h)
        back *= h
        inner = (seen.T @ back).reshape(self.inner.shape)
        # Sums of the rows of each class seen at any place.
        by_place = np.matmul(back, self.inner.reshape(-1, HIDDEN).T, out=_space("places", n, seen.shape[1], h.dtype)).reshape(-1, EMBED)
        classes = context.ravel()
        place = _order(classes)
        classes = classes[place]
        first_row, embed = _firsts(classes), np.zeros_like(self.embed)
        ordered = np.take(by_place, place, axis=0, out=_space("ordered", n, seen.shape[1], h.dtype).reshape(-1, EMBED), mode="clip")
        embed[classes[first_row]] = np.add.reduceat(ordered, first_row, axis=0)
        return embed, inner, back.sum(axis=0), by_group, own


def _runs(numbers: np.ndarray) -> list[tuple[int, slice]]:
    """Each number and the slice of it, of numbers in order."""
    cuts = [*_firsts(numbers).tolist(), len(numbers)]
    return [(int(numbers[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def word_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """word, n for every word of all documents."""
    words = docs.select(F.explode(F.split(F.lower(text), SPACE_CLASS)).alias("word")).filter("word <> ''")
    return stored(words.groupBy("word").agg(F.count("*").alias("n")))


def corpus_classes(docs: DataFrame, *, text: str = "text", frequent: int = FREQUENT, counts: DataFrame | None = None) -> tuple[Classes, np.ndarray]:
    """The classes, and the share of each among all words of all documents (one added to every count)."""
    counts = word_counts(docs, text=text) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).collect()
    classes = Classes([r.word for r in top])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes.size)
        for part in slices(batches, 8192):
            total += np.bincount(classes.of(part.column(0).to_pylist()), part.column(1).to_numpy(), classes.size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes.size)), pa.array(total)], names=["class", "n"])

    found = counts.mapInArrow(add_up, "class long, n double").groupBy("class").agg(F.sum("n").alias("n")).collect()  # a row for each class
    total = np.ones(classes.size)
    for r in found:
        total[r["class"]] += r.n
    classes.total = total
    return classes, total / total.sum()


#: Of a word: class, hash (Spark's xxhash64), log of its share in the class (NaN if the table has to tell), and that log if it was not counted.
DESCRIBED = np.dtype([("class", np.int32), ("hash", np.int64), ("log", np.float64), ("unseen", np.float64)])


class Vocabulary:
    """Describes words by what is known of them without the table of counts."""

    def __init__(self, classes: Classes, known: dict[int, float]):
        self.classes, self.known = classes, known

    def of(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), DESCRIBED)
        out["class"] = classes = self.classes.of(words)
        rare = np.flatnonzero(classes >= len(self.classes.number))
        raw = [words[i].encode() for i in rare.tolist()]
        hashes = np.array([xxhash.xxh64_intdigest(x, 42) for x in raw], dtype=np.uint64).view(np.int64)
        out["hash"][rare] = hashes
        out["log"][rare] = [self.known.get(h, np.nan) for h in hashes.tolist()]
        out["unseen"][rare] = -np.log(self.classes.total)[classes[rare]] - (np.array([len(x) for x in raw], dtype=np.int64) + 1) * np.log(257)
        return out


@dataclass
class Shares:
    """table: hash, log (of n by the class's words and one) of the words that the vocabulary doesn't know."""

    vocabulary: Vocabulary
    table: DataFrame


def word_shares(counts: DataFrame, classes: Classes, *, known: int = KNOWN) -> Shares:
    """The share of every counted word in its class; at most known of them reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 8192):
            words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
            own = classes.of(words)
            columns = [part.column("hash"), part.column("n"), pa.array(np.log(n) - np.log(classes.total)[own])]
            yield pa.RecordBatch.from_arrays(columns, names=["hash", "n", "log"]).filter(pa.array(own >= len(classes.number)))

    table = stored(counts.select("word", "n", F.xxhash64("word").alias("hash")).mapInArrow(run, "hash long, n long, log double"))
    # A level of counts, a power of two, that few enough words reach.
    sizes = {r.power: r["count"] for r in table.groupBy((F.length(F.bin("n")) - 1).alias("power")).count().collect()}
    level = max(sizes, default=0) + 1
    while level > 0 and sum(c for p, c in sizes.items() if p >= level - 1) <= known:
        level -= 1
    near = table.filter(F.col("n") >= 2**level).select("hash", "log").toArrow()
    own = dict(zip(near.column(0).to_pylist(), near.column(1).to_pylist(), strict=True))
    return Shares(Vocabulary(classes, own), table.filter(F.col("n") < 2**level).select("hash", "log"))


def _texts(part: pa.RecordBatch, at: int) -> list[str]:
    return [(t or "").lower() for t in part.column(at).to_pylist()]


@dataclass
class Reading:
    """Texts as the numbers of their words' classes, so that words are parted and looked up once.

    table: row, key, n_tokens, classes (numbers of classes.kind as binary; null for a null text),
    known (the sum of the shares' logs that the vocabulary knows), hash and unseen (of all other
    words without a class of their own). Without shares only classes are told."""

    classes: Classes
    shares: Shares | None
    table: DataFrame


def read(docs: DataFrame, classes: Classes, *, key: str = "doc_id", text: str = "text", shares: Shares | None = None) -> Reading:
    """Every row of docs, stored: training and scoring don't read texts, and numbers of rows are safe to join on."""
    whole, words = shares is not None, shares.vocabulary if shares else classes
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if not _HELD or _HELD[0][0] is not own:
            _HELD[:] = [(own, WordTable(own.of, 400_000, ascii_words))]
        table = _HELD[0][1]
        for part in slices(batches, 128):
            found, ends = table.look_up(_texts(part, 1))
            rest = np.isnan(found["log"]) if whole else np.zeros(len(found), dtype=bool)
            known = sums_by_text(np.where(rest, 0, found["log"]), ends) if whole else np.zeros(len(ends))
            cuts = pa.array(np.concatenate([[0], np.cumsum(rest)[ends - 1] * (ends > 0)]) if len(found) else np.zeros(len(ends) + 1, np.int64), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(found[c][rest] if whole else np.zeros(0, DESCRIBED[c]))) for c in ("hash", "unseen")]
            numbers, begin, own_numbers = (found["class"] if whole else found).astype(kind), 0, []
            for end, there in zip(ends.tolist(), part.column(1).is_valid().to_pylist(), strict=True):
                own_numbers.append(numbers[begin:end].tobytes() if there else None)
                begin = end
            columns = [part.column(0), pa.array(np.diff(ends, prepend=0)), pa.array(own_numbers, pa.binary()), pa.array(known), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "classes", "known", "hash", "unseen"])

    kind, picked = classes.kind, docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    columns = f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, classes binary, known double, hash array<long>, unseen array<double>"
    return Reading(classes, shares, stored(picked.mapInArrow(run, columns).withColumn("row", F.monotonically_increasing_id())))


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts one after another, and where each text's end."""
    own = [np.frombuffer(x or b"", kind) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, kind), *own]), np.cumsum([len(x) for x in own], dtype=np.int64)


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS, frequent: int = FREQUENT, counts: DataFrame | None = None) -> WindowNetwork:
    """A network whose classes, shares and weights come from all of docs; training starts on at
    most sample keys (those with the lowest hash). Without words it is uniform."""
    classes, share = corpus_classes(docs, text=text, frequent=frequent, counts=counts)
    return fitted(read(docs, classes, key=key, text=text), share, sample=sample)


def fitted(reading: Reading, share: np.ndarray, *, sample: int = SAMPLE_DOCS) -> WindowNetwork:
    """train for texts that are read; share: of each class among all words."""
    picked = reading.table.select("key", "classes").filter("classes IS NOT NULL")
    keys = picked.select("key").orderBy(F.xxhash64("key", F.lit(3)), "key").limit(sample).distinct()
    # A key that repeats brings all its rows; the first sample of them reach the driver.
    found = picked.join(F.broadcast(keys), "key").orderBy(F.col("key").cast("string"), "classes").limit(sample).select("classes").toArrow()
    flat, ends = _numbers(found.column(0), reading.classes.kind)
    return _averaged(picked.select("classes"), WindowNetwork(reading.classes, share).fit(flat, ends))


def _averaged(picked: DataFrame, network: WindowNetwork) -> WindowNetwork:
    """The network after a pass over all texts: every partition trains a copy on its own, and the
    copies are averaged by their words. Weights go in packs; their sums reach the driver."""
    shared = picked.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, held, words, total = copy.deepcopy(shared.value), {}, [], 0, 0

        def learn() -> None:
            own.fit(np.concatenate([c for c, _ in held]), np.concatenate([e for _, e in held]), epochs=1, state=state)
            held.clear()

        for part in slices(batches, 128):
            classes, ends = _numbers(part.column(0), own.classes.kind)
            if len(classes):
                held.append((classes, ends + words))
                words, total = words + len(classes), total + len(classes)
            if words >= CHUNK:
                learn()
                words = 0
        if held:
            learn()
        if total:
            flat = np.concatenate([[1.0], *(w.ravel() for w in own.weights())]) * total
            begins = range(0, len(flat), PACK)
            yield pa.RecordBatch.from_arrays([pa.array(begins, pa.int32()), pa.array([flat[a : a + PACK].tobytes() for a in begins])], names=["at", "weights"])

    def add_up(group: pa.Table) -> pa.Table:
        # In the order of their bytes, so that the sum doesn't depend on that of the rows.
        total = np.sum([np.frombuffer(x) for x in sorted(group.column("weights").to_pylist())], axis=0)
        return pa.table({"at": group.column("at").slice(0, 1), "weights": pa.array([total.tobytes()])})

    packs = "at int, weights binary"
    found = picked.mapInArrow(run, packs).groupBy("at").applyInArrow(add_up, packs).toArrow().sort_by("at")
    flat, at = np.frombuffer(b"".join(found.column("weights").to_pylist())), 1
    if len(flat):
        for w in network.weights():
            w[...] = (flat[at : at + w.size] / flat[0]).reshape(w.shape)
            at += w.size
    return network


_HELD: list[tuple[object, WordTable]] = []


def score(docs: DataFrame, network: WindowNetwork, *, key: str = "doc_id", text: str = "text", shares: Shares | None = None) -> DataFrame:
    """key, n_tokens, log_likelihood (the sum over words) and mean_log_likelihood of every row.

    Without shares only the classes of words are predicted. A text that is null
    or has no word has a sum of 0 and a null mean. Repeated rows get equal
    scores; an empty table gives none; other columns are not read."""
    return scored(read(docs, network.classes, key=key, text=text, shares=shares), network, key=key)


def scored(reading: Reading, network: WindowNetwork, *, key: str = "doc_id") -> DataFrame:
    """score for texts that are read."""
    shared = reading.table.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, 128):
            classes, ends = _numbers(part.column("classes"), own.classes.kind)
            logs = sums_by_text(own.log_probabilities(windows(classes, ends, own.classes.size, own.window), classes), ends)
            columns = [*(part.column(c) for c in ("row", "key", "n_tokens")), pa.array(logs + part.column("known").to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "key", "n_tokens", "total"])

    kind = reading.table.schema["key"].dataType.simpleString()
    found = reading.table.select("row", "key", "n_tokens", "classes", "known").mapInArrow(run, f"row long, key {kind}, n_tokens long, total double")
    total = F.col("total")
    if reading.shares:
        rest = reading.table.select("row", F.explode(F.arrays_zip("hash", "unseen")).alias("w")).select("row", "w.hash", "w.unseen")
        more = rest.join(reading.shares.table, "hash", "left").groupBy("row").agg(F.sum(F.coalesce("log", "unseen")).alias("more"))
        found, total = found.join(more, "row", "left"), F.col("total") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return found.select(F.col("key").alias(key), "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"))
