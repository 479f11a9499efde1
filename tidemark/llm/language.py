"""Operator 4: language ID by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood in a language is the sum over all ways to cut it into
pieces of the product of their probabilities, computed by the forward
algorithm; a text's is the product over its words (no piece spans a space).
Words are runs of letters with their combining marks, in training and
prediction alike. Probabilities are learned by expectation-maximisation from a
bounded sample of labelled texts of each language: forward and backward sums
give the expected number of uses of each piece, which Spark adds up over the
sample's distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored
from tidemark.llm.words import WordTable, sums_by_text

START = "▁"
#: Labelled documents of each language that the probabilities are learned from, at most (those with the lowest hash).
SAMPLE_DOCS = 1500
#: EM rounds, and the prior count of a piece.
ROUNDS, PRIOR = 3, 0.05
#: Longest word whose sums are tried as they are; those of longer ones, and of words with a sum below TINY, are kept as logarithms.
LINEAR, TINY = 32, 1e-280
#: Cells of the forward sums that are held at a time.
CELLS = 2_000_000
#: Probability of a character that no piece begins with.
UNKNOWN = 1e-7


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, in its order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not odd(i)]


_RUN = regex.compile(r"\p{M}*\p{L}[\p{L}\p{M}]*")


def letter_runs(word: str) -> list[str]:
    """The lower-case runs of letters of a word; combining marks belong to them, all else parts them."""
    return [word.lower()] if word.isalpha() else _RUN.findall(word.lower())


class Pieces:
    """The vocabulary with its prefixes, and a row of probabilities for each piece."""

    def __init__(self, pieces: list[str], probability: np.ndarray):
        """probability: a row for each piece, a column for each language."""
        self.table: dict[str, int] = {}  # -1: only a prefix of pieces
        for i, p in enumerate(pieces):
            for cut in range(1, len(p)):
                self.table.setdefault(p[:cut], -1)
            self.table[p] = i
        self.unknown = len(pieces)
        self.probability = np.concatenate([probability, np.full((1, probability.shape[1]), UNKNOWN)])

    def arcs(self, word: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) for all pieces in word; a character that is no piece is an unknown one."""
        n, out, table = len(word), [], self.table
        for i in range(n):
            if table.get(word[i], -1) < 0:
                out.append((i, i + 1, self.unknown))
            for j in range(i + 1, n + 1):
                piece = table.get(word[i:j])
                if piece is None:
                    break
                if piece >= 0:
                    out.append((i, j, piece))
        return out

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """The log of each word's probability in each language; all segmentations summed.

        The forward sums of many words advance together, a start position at a time."""
        out = np.zeros((len(words), self.probability.shape[1]))
        spelled = [START + w for w in words]
        order = sorted((i for i, w in enumerate(spelled) if len(w) <= LINEAR), key=lambda i: len(spelled[i]))
        step, faint = max(1, CELLS // ((LINEAR + 1) * max(1, out.shape[1]))), []
        for at in range(0, len(order), step):
            part = order[at : at + step]
            sums = self._forward([spelled[i] for i in part])
            out[part] = np.log(np.maximum(sums, TINY))
            faint += [part[i] for i in np.nonzero(sums.min(axis=1, initial=1.0) < TINY)[0]]
        for i in [*faint, *(i for i, w in enumerate(spelled) if len(w) > LINEAR)]:
            start, stop, piece = self._by_stop(spelled[i])
            out[i] = _log_sums(start, stop, self.logs[piece], len(spelled[i]))[-1]
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        found = [self.arcs(w) for w in words]
        row = np.repeat(np.arange(len(words)), [len(x) for x in found])
        start, stop, piece = np.array([x for own in found for x in own], dtype=np.int64).reshape(-1, 3).T
        order = np.argsort(start, kind="stable")
        row, start, stop, piece = row[order], start[order], stop[order], piece[order]
        longest = max(map(len, words), default=0)
        forward = np.zeros((len(words), longest + 1, self.probability.shape[1]))
        forward[:, 0] = 1.0
        cuts = np.searchsorted(start, np.arange(longest + 1))
        for i in range(longest):
            own = slice(cuts[i], cuts[i + 1])  # a word has at most one arc to each position here
            forward[row[own], stop[own]] += forward[row[own], i] * self.probability[piece[own]]
        return forward[np.arange(len(words)), [len(w) for w in words]]

    def _by_stop(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, stop, piece = np.array(self.arcs(word), dtype=np.int64).reshape(-1, 3).T
        order = np.argsort(stop, kind="stable")
        return start[order], stop[order], piece[order]

    def expected(self, word: str, language: int, times: float, counts: np.ndarray) -> None:
        """Adds the expected uses of pieces in times words to counts."""
        word = START + word
        n = len(word)
        p, arcs = self.columns[language], self.arcs(word)
        forward = [1.0] + [0.0] * n
        if n <= LINEAR:
            for i, j, piece in arcs:
                forward[j] += forward[i] * p[piece]
        if forward[n] < TINY:
            start, stop, piece = self._by_stop(word)
            logs = self.logs[piece, language][:, None]
            forward, back = _log_sums(start, stop, logs, n), np.lexsort((-stop, n - start))
            backward = _log_sums((n - stop)[back], (n - start)[back], logs[back], n)[::-1]
            uses = times * np.exp(forward[start] + logs + backward[stop] - forward[n])[:, 0]
            known = piece != self.unknown
            np.add.at(counts, piece[known], uses[known])
            return
        backward = [0.0] * n + [1.0]
        for i, j, piece in reversed(arcs):
            backward[i] += backward[j] * p[piece]
        scale = times / forward[n]
        for i, j, piece in arcs:
            if piece != self.unknown:
                counts[piece] += forward[i] * p[piece] * backward[j] * scale

    @property
    def logs(self) -> np.ndarray:
        if not hasattr(self, "_logs"):
            self._logs = np.log(self.probability)
        return self._logs

    @property
    def columns(self) -> list[list[float]]:
        if not hasattr(self, "_columns"):
            self._columns = self.probability.T.tolist()
        return self._columns


def _log_sums(start: np.ndarray, stop: np.ndarray, logs: np.ndarray, n: int) -> np.ndarray:
    """Logs of the forward sums at positions 0 to n (a column for each language); arcs in the order of stop."""
    out = np.zeros((n + 1, logs.shape[1]))
    cuts = np.searchsorted(stop, np.arange(n + 2)).tolist()
    for j in range(1, n + 1):
        own = slice(cuts[j], cuts[j + 1])
        x = out[start[own]] + logs[own]
        most = x.max(axis=0)
        out[j] = most + np.log(np.exp(x - most).sum(axis=0))
    return out


class LanguageModel:
    """Languages, pieces and probabilities; pickled to the tasks (vocabulary times languages floats)."""

    def __init__(self, languages: list[str], pieces: list[str], probability: np.ndarray):
        self.languages, self.pieces, self.probability = languages, pieces, probability


def train(docs: DataFrame, pieces: list[str], *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Probabilities from at most sample rows of each language in docs that have a text.

    The words of the sample are counted by language in Spark; each round's
    expected counts are added up there too. Without labelled rows there are no
    languages, and every text is undetermined."""
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    # A hash thins out each language to little more than the sample before its rows are ordered.
    order = F.xxhash64("key", "text", F.lit(4))
    sizes = picked.groupBy("lang").agg(F.approx_count_distinct(order).alias("rows"))
    # One row a language, as many as the model has columns: sent to the texts, which stay where they are.
    thin = picked.join(F.broadcast(sizes), "lang").filter(F.pmod(order, F.lit(1 << 30)) * F.col("rows") < F.lit(1.5 * sample * (1 << 30)))
    nth = F.row_number().over(W.partitionBy("lang").orderBy(order, "key"))
    chosen = thin.withColumn("nth", nth).filter(F.col("nth") <= sample).select("lang", "text")
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), "\\s+")).alias("word")).filter("word <> ''")
    counts = stored(words.groupBy("lang", "word").agg(F.count("*").alias("n")))
    languages = [r.lang for r in counts.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)))
    column = {x: k for k, x in enumerate(languages)}
    probability = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((pieces, probability))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Pieces(*shared.value)
            total = np.zeros(shared.value[1].shape)
            for batch in batches:
                uses: dict[tuple[str, str], int] = {}
                for x, word, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    for run in letter_runs(word):
                        uses[x, run] = uses.get((x, run), 0) + n
                for (x, run), n in uses.items():
                    own.expected(run, column[x], n, total[:, column[x]])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k])], names=["piece", "k", "uses"])

        dealt = counts.repartition(F.xxhash64("word") % 4096)
        uses = dealt.mapInArrow(expect, "piece long, k long, uses double").groupBy("piece", "k").agg(F.sum("uses").alias("uses"))
        found = uses.toPandas()  # at most a row for each piece and language
        total = np.full(probability.shape, PRIOR)
        total[found.piece, found.k] += found.uses
        probability = total / total.sum(axis=0)
        shared.unpersist()
    return LanguageModel(languages, pieces, probability)


_HELD: dict[int, tuple] = {}


def predict(docs: DataFrame, model: LanguageModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (the language's posterior, 0 to 1) of every row.

    A text that is null or has no letter is "und" with score 0. Equal
    likelihoods go to the language first in order. Other columns are not read;
    repeated rows get equal results; an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = own.languages
        if id(own) not in _HELD:
            pieces = Pieces(own.pieces, own.probability)

            known: dict[str, np.ndarray] = {}  # by runs of letters

            def describe(words: list[str]) -> np.ndarray:
                runs = [letter_runs(w) for w in words]
                if len(known) > 400_000:
                    known.clear()
                fresh = list({r for own in runs for r in own if r not in known})
                for at in range(0, len(fresh), 4096):
                    some = fresh[at : at + 4096]
                    known.update(zip(some, pieces.log_likelihoods(some), strict=True))
                out = np.zeros((len(words), len(names) + 1))
                for row, own in zip(out, runs, strict=True):
                    for run in own:
                        row[0] = 1.0
                        row[1:] += known[run]
                return out

            _HELD.clear()
            _HELD[id(own)] = (own, WordTable(describe, 600_000))
        table = _HELD[id(own)][1]
        for part in slices(batches, 128):
            values, ends = table.look_up([t or "" for t in part.column(1).to_pylist()])
            sums = sums_by_text(values, ends)
            has, logs = sums[:, 0] > 0.5, sums[:, 1:]
            if names:
                best = logs.argmax(axis=1)
                score = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                pred = [names[k] if h else "und" for k, h in zip(best.tolist(), has.tolist(), strict=True)]
            else:
                pred, score = ["und"] * len(sums), np.zeros(len(sums))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(np.where(has, score, 0.0))], names=["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
