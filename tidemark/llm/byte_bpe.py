"""Operator 7: byte-level BPE encoding and decoding with a segment tree per pre-token.

A text is cut by the public split pattern; each match is encoded on its own.
For a match of L bytes, the leaves of a segment tree hold the rank of the pair
that starts at a byte position, and each inner node the leftmost minimum of its
two children. One merge reads the root, joins the pair, and updates the leaves
of the pair and of its live left neighbour: O(log L) each. Short matches are
merged many at a time: the trees of all of them are rows of one array.

Texts repeat their words, so a worker keeps the ids of recent matches in a
bounded cache; rows are never grouped, so no key can be hot and nothing is
shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices

#: No pair: above every key of a segment tree.
NONE = np.int32(2**31 - 1)
#: Matches of more bytes than this are merged one at a time.
LONG = 64
#: Multiplier of the hash table of pairs (2**64 divided by the golden ratio).
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def read_tokenizer(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Tokens and merges of a byte-level BPE in a tokenizer's JSON file.

    The file writes bytes as printable characters: those of printable Latin-1
    stand for themselves, the others count on from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = plain + [b for b in range(256) if b not in plain]
    byte = {chr(b if k < len(plain) else 256 + k - len(plain)): b for k, b in enumerate(shown)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    raw = lambda token: bytes(byte[c] for c in token)
    ranks = {raw(t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return ranks, merges


class ByteBpe:
    """Encoder and decoder for a vocabulary whose ids order its merges.

    Without merges, any two tokens whose concatenation is a token may merge."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, merges: list[tuple[bytes, bytes]] | None = None):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.byte_ids = self.byte_id.tolist()
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, i in ranks.items():
            tokens[i] = t
        self.token_bytes = Ragged(tokens)
        self.token_text = Ragged([b"%d," % i for i in range(size)])
        if merges is None:
            merges = [(t[:k], t[k:]) for t in ranks for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = {ranks[a] << 32 | ranks[b]: ranks[a + b] for a, b in merges}
        self._fill_table()

    def _fill_table(self) -> None:
        """Open addressing with linear probes; at most an eighth is filled."""
        bits = max(10, (8 * len(self.pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        slots = np.full(1 << bits, -1, dtype=np.int64)
        ranks = np.full(1 << bits, NONE, dtype=np.int32)
        keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        for key, at, rank in zip(keys.tolist(), self._slot(keys).tolist(), self.pairs.values(), strict=True):
            while slots[at] != -1:
                at = (at + 1) & self.mask
            slots[at], ranks[at] = key, rank
        self.slots, self.slot_ranks = slots, ranks

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    # -- encoding ---------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where the pair is no token."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.slot_ranks[at], NONE)
        rest = np.nonzero((found != keys) & (found != -1))[0]
        while rest.size:
            at[rest] = (at[rest] + 1) & self.mask
            found = self.slots[at[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.slot_ranks[at[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out

    def encode_one(self, piece: bytes) -> list[int]:
        """The ids of one match of any length."""
        n = len(piece)
        if n < 2:
            return [self.byte_ids[b] for b in piece]
        size = 1 << (n - 1).bit_length()
        ids = [self.byte_ids[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        absent = 1 << 62
        tree = [absent] * (2 * size)  # rank * size + position: the minimum is the leftmost of the lowest rank
        for p in range(n - 1):
            r = get(ids[p] << 32 | ids[p + 1])
            if r is not None:
                tree[size + p] = r * size + p
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b

        def put(p: int, value: int) -> None:
            k = size + p
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    return
                tree[k] = low
                k >>= 1

        while (top := tree[1]) != absent:
            rank, p = divmod(top, size)
            gone = after[p]
            nxt = after[gone]
            ids[p], after[p], ids[gone] = rank, nxt, -1
            put(gone, absent)
            if nxt < n:
                before[nxt] = p
                r = get(rank << 32 | ids[nxt])
                put(p, absent if r is None else r * size + p)
            else:
                put(p, absent)
            if (q := before[p]) >= 0:
                r = get(ids[q] << 32 | rank)
                put(q, absent if r is None else r * size + q)
        return [i for i in ids if i >= 0]

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and the number of each piece's.

        Pieces of like length share one array of trees."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        parts, rows = [], []
        size = 1
        while size <= LONG:
            own = np.nonzero((lengths <= size) & (lengths > size // 2 if size > 1 else lengths <= 1))[0]
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                ids, counts = self._merge([pieces[i] for i in some.tolist()], lengths[some], size)
                parts.append((ids, counts))
                rows.append(some)
            size *= 2
        for i in np.nonzero(lengths > LONG)[0].tolist():
            ids = np.array(self.encode_one(pieces[i]), dtype=np.int32)
            parts.append((ids, np.array([len(ids)])))
            rows.append(np.array([i]))
        if not rows:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat, counts = np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])
        starts = np.cumsum(counts) - counts
        back = np.argsort(np.concatenate(rows))
        return flat[spans(starts[back], counts[back])], counts[back]

    def _merge(self, pieces: list[bytes], lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(pieces)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), dtype=np.uint8).reshape(m, size)
        inside = np.arange(size) < lengths[:, None]
        ids = np.where(inside, self.byte_id[raw], np.int32(-1))
        if size > 1:
            self._merge_rows(ids, lengths.astype(np.int32), inside, size)
        keep = ids >= 0
        return ids[keep], keep.sum(axis=1)

    def _merge_rows(self, ids: np.ndarray, lengths: np.ndarray, inside: np.ndarray, size: int) -> None:
        m, depth = len(ids), size.bit_length() - 1
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (m, 1)).ravel()
        before = np.tile(np.arange(-1, size - 1, dtype=np.int32), (m, 1)).ravel()
        tree = np.full((m, 2 * size), NONE, dtype=np.int32)
        r, p = np.nonzero(inside[:, 1:])
        rank = self._rank(ids[r, p], ids[r, p + 1])
        known = rank != NONE
        tree[r[known], size + p[known]] = (rank[known] << depth) + p[known].astype(np.int32)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        tree, ids = tree.ravel(), ids.ravel()

        def put(base: np.ndarray, pos: np.ndarray, value: np.ndarray | np.int32) -> None:
            """Set leaves (base: where a row's tree begins) and the minima above them."""
            node = pos + size
            tree[base + node] = value
            for _ in range(depth):  # all leaves have the same depth
                pair = base + (node & ~1)
                node = node >> 1
                tree[base + node] = np.minimum(tree[pair], tree[pair + 1])

        def key(rank: np.ndarray, pos: np.ndarray) -> np.ndarray:
            return np.where(rank == NONE, NONE, (np.where(rank == NONE, 0, rank) << depth) + pos)

        live = np.nonzero(tree[1 :: 2 * size] != NONE)[0]
        while live.size:
            base, row = live * (2 * size), live * size
            top = tree[base + 1]
            rank, p = top >> depth, top & (size - 1)
            gone = after[row + p]
            nxt = after[row + gone]
            ids[row + p], ids[row + gone], after[row + p] = rank, -1, nxt
            put(base, gone, NONE)
            value = np.full(live.size, NONE, dtype=np.int32)
            has = np.nonzero(nxt < lengths[live])[0]
            at = row[has] + nxt[has]
            before[at] = p[has]
            value[has] = key(self._rank(rank[has], ids[at]), p[has])
            put(base, p, value)
            left = before[row + p]
            has = np.nonzero(left >= 0)[0]
            if has.size:
                pos = left[has]
                put(base[has], pos, key(self._rank(ids[row[has] + pos], rank[has]), pos))
            live = live[tree[base + 1] != NONE]

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return self.encode_many([m.encode() for m in self.pattern.findall(text)])[0].tolist()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return self.token_bytes.joined(np.asarray(ids, dtype=np.int64))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans (start, length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Ragged:
    """Byte strings by number, put together without a Python loop."""

    def __init__(self, items: list[bytes]):
        self.length = np.array([len(x) for x in items], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(items), dtype=np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        return self.flat[spans(self.start[numbers], self.length[numbers])].tobytes()


def chunks(text: str) -> list[str]:
    """text cut before every space and newline.

    The split pattern never joins what such a cut parts if all chunks are words (is_word): each
    can then be encoded alone."""
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def is_word(chunk: str) -> bool:
    """Whether a chunk is a word without white space, but for one space or newline before it."""
    words = chunk.split()
    return len(words) == 1 and len(words[0]) == len(chunk) - (chunk[0] in " \n")


class TextEncoder:
    """Encodes texts; remembers the ids of up to ``most`` chunks, then begins anew."""

    def __init__(self, bpe: ByteBpe, most: int = 1_000_000):
        self.bpe, self.most = bpe, most
        self._reset()

    def _reset(self) -> None:
        self.numbers = defaultdict(count().__next__)  # of chunks, in the order of their first lookup
        self.known = 0
        self.start, self.count, self.plain = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1024, bool)
        self.flat, self.used = np.zeros(4096, np.int32), 0

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if (need := self.used + len(ids)) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(need, len(self.flat)), np.int32)])
        self.flat[self.used : need] = ids
        self.start[numbers] = self.used + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.used = need

    def _grow(self, size: int) -> None:
        if (short := size - len(self.start)) > 0:
            more = max(short, len(self.start))
            self.start, self.count, self.plain = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.start, self.count, self.plain))

    def _learn(self) -> None:
        """Encodes the new chunks: single matches by merging, others from the ids of their matches."""
        numbers, findall = self.numbers, self.bpe.pattern.findall
        single, single_at, parts, parts_at, parts_n = [], [], [], [], []
        while self.known < len(numbers):  # matches of a chunk may be new themselves
            first = self.known
            new = list(islice(reversed(numbers), len(numbers) - first))[::-1]
            self.known += len(new)
            alone = [c[1:].isalpha() and c[0] == " " for c in new]
            single += compress(new, alone)
            single_at += compress(range(first, self.known), alone)
            plain = np.array(alone)
            for at in np.flatnonzero(~plain).tolist():
                found, plain[at] = findall(new[at]), is_word(new[at])
                if not found:
                    continue
                if len(found) == 1:
                    single.append(new[at])
                    single_at.append(first + at)
                else:
                    parts += map(numbers.__getitem__, found)
                    parts_at.append(first + at)
                    parts_n.append(len(found))
            self._grow(self.known)
            self.plain[first : self.known] = plain
        self._keep(np.array(single_at, dtype=np.int64), *self.bpe.encode_many([c.encode() for c in single]))
        if parts_at:
            own = np.array(parts, dtype=np.int64)
            lengths = np.add.reduceat(self.count[own], np.cumsum(parts_n) - parts_n)
            self._keep(np.array(parts_at, dtype=np.int64), self.flat[spans(self.start[own], self.count[own])], lengths)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's end."""
        if len(self.numbers) > self.most:
            self._reset()
        number = self.numbers.__getitem__

        def look_up(chunks: list[str]) -> np.ndarray:
            return np.fromiter(map(number, chunks), dtype=np.int32, count=len(chunks))

        def learnt() -> np.ndarray:
            if self.known < len(self.numbers):
                self._learn()
            return np.concatenate(rows) if rows else np.zeros(0, np.int32)

        cut = [bool(t) and "\0" not in t for t in texts]
        rows = [look_up(chunks(t) if c else self.bpe.pattern.findall(t)) for t, c in zip(texts, cut, strict=True)]
        own = learnt()
        if not (plain := self.plain[own]).all():
            # Texts with other chunks than words are cut by the pattern.
            odd = np.unique(np.searchsorted(np.cumsum([len(r) for r in rows]), np.flatnonzero(~plain), side="right"))
            for i in (i for i in odd.tolist() if cut[i]):
                rows[i] = look_up(self.bpe.pattern.findall(texts[i]))
            own = learnt()
        counts = self.count[own]
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.cumsum([len(r) for r in rows])] if rows else np.zeros(0, np.int64)
        return self.flat[spans(self.start[own], counts)], ends


_HELD: dict[tuple[str, str], TextEncoder] = {}


def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for a worker process; path is a rank file or a tokenizer's JSON file."""
    if (path, pattern) not in _HELD:
        if path.endswith(".json"):
            ranks, merges = read_tokenizer(path)
        else:
            ranks, merges = read_ranks(path), None
        bpe = ByteBpe(ranks, pattern, merges)
        _HELD[path, pattern] = TextEncoder(bpe)
    return _HELD[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, ids (array of int), ids_sha256, decoded (binary) of its text.

    A null text counts as empty: no ids, no bytes. Repeated rows are encoded
    alike and all returned; an empty table gives an empty result; other
    columns of docs are not read, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        shown, spelt = encoder.bpe.token_text, encoder.bpe.token_bytes
        for part in slices(batches, 128):
            ids, ends = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            bounds = [0, *ends.tolist()]
            own = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array([hashlib.sha256(shown.joined(x)[:-1]).hexdigest() for x in own], pa.string()),
                    pa.array([spelt.joined(x) for x in own], pa.binary()),
                ],
                names=["key", "ids", "ids_sha256", "decoded"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(run, f"key {kind}, ids array<int>, ids_sha256 string, decoded binary")
        .withColumnRenamed("key", key)
    )


def decode_column(encoded: DataFrame, path: str, pattern: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded (binary) for an array<int> column of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_encoder(path, pattern).bpe
        for part in slices(batches, 256):
            back = [None if x is None else bpe.decode(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(back, pa.binary())], names=["key", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return (
        encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
        .mapInArrow(run, f"key {kind}, decoded binary")
        .withColumnRenamed("key", key)
    )
