"""Operator 5: vector bin packing of examples under several limits at once.

An example is a vector (tokens, segments, loss-bearing tokens); a sequence is
a bin with a limit on each. Bins are filled one after another by the
dot-product heuristic: of the examples that still fit, the one whose vector has
the largest dot product with the bin's remaining capacity goes in, each
dimension weighed by its share of the total demand.

Examples are dealt by a hash of their key into groups of about ``group_rows``,
so that every task packs a bounded number of them, whatever the key's
distribution. A group of thousands of examples leaves one partly filled bin at
most once gaps are closed by cutting, so dealing costs next to no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import text_encoder
from tidemark.llm.common import slices

#: Limits of a sequence: tokens, segments, tokens that bear loss.
LIMITS = (1024, 16, 960)
#: One in so many of a document's ids, at its beginning, is its prompt, which bears no loss.
PROMPT_PART = 8
GROUP_ROWS = 4096


def dot_product_packing(sizes: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Bins (lists of rows of sizes) by the dot-product heuristic.

    sizes: rows of demands, none above limits. Equal products go to the
    earlier row, so the result depends on the input alone."""
    sizes = np.asarray(sizes, dtype=np.float64)
    if not len(sizes):
        return []
    limits = np.asarray(limits, dtype=np.float64)
    unit = sizes / limits
    weight = unit.sum(axis=0)
    weight = weight / max(weight.sum(), 1e-12)
    order = np.argsort(-(unit @ weight), kind="stable")  # the first maximum is then the larger example
    unit, left = unit[order], np.arange(len(sizes))
    bins = []
    while left.size:
        free, own, demand = np.ones(len(limits)), [], unit[left]
        open_rows = np.ones(left.size, dtype=bool)
        while True:
            fits = open_rows & (demand <= free + 1e-9).all(axis=1)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, demand @ (weight * free), -1.0)))
            own.append(int(order[left[best]]))
            free -= demand[best]
            open_rows[best] = False
        bins.append(own)
        left = left[open_rows]
    return bins


def loss_bearing(start: int, length: int, prompt: int) -> int:
    """Ids of a piece that bear loss: none of the document's prompt, and not the first of the
    segment, which has no context."""
    return max(0, start + length - max(start + 1, prompt))


def close_gaps(bins: list[list[tuple[int, int, int]]], limits: tuple[int, int, int], prompts: list[int]) -> list[list[tuple[int, int, int]]]:
    """Bins of pieces (row, start, length) after their gaps are filled by cutting.

    The emptiest bins give: a gap takes the head of a piece of the bin that
    holds the least, as far as the limits on segments and loss allow it. What
    is left of a bin with a gap of over a sixteenth is cut at powers of two,
    which need no padding. prompts: the length of each row's prompt."""
    tokens, segments, loss = limits
    bins = sorted(bins, key=lambda b: -sum(x[2] for x in b))
    fill = [sum(x[2] for x in b) for b in bins]
    give = len(bins) - 1
    for at in range(len(bins)):
        borne = sum(loss_bearing(start, length, prompts[row]) for row, start, length in bins[at])
        while at < give and fill[at] < tokens and len(bins[at]) < segments:
            if not bins[give]:
                give -= 1
                continue
            row, start, length = bins[give][-1]
            # The longest head whose ids that bear loss still fit.
            take = min(tokens - fill[at], max(start + 1, prompts[row]) - start + loss - borne, length)
            bins[give].pop()
            bins[at].append((row, start, take))
            borne += loss_bearing(start, take, prompts[row])
            fill[at] += take
            fill[give] -= take
            if take < length:
                bins[give].append((row, start + take, length - take))
            if borne >= loss:
                break
    out = []
    for pieces in (b for b in bins if b):
        total = sum(x[2] for x in pieces)
        if tokens - total <= tokens // 16 or len(pieces) == segments:
            out.append(pieces)
            continue
        pieces = list(pieces)
        while pieces:  # sequences of 512, 256, ... tokens
            want, own = 1 << (sum(x[2] for x in pieces).bit_length() - 1), []
            while want:
                row, start, length = pieces.pop()
                take = min(want, length)
                own.append((row, start, take))
                want -= take
                if take < length:
                    pieces.append((row, start + take, length - take))
            out.append(own)
    return out


def whole_sequences(n: int, prompt: int, limits: tuple[int, int, int]) -> tuple[list[list[tuple[int, int]]], int, int]:
    """Full sequences of one document of n ids, as pieces (start, length), and the range of ids that is left.

    A piece beyond the prompt may be longer by one than the limit on loss, for its
    first id bears none. What such a sequence has left is filled from the prompt's
    beginning, whose ids bear none at all; without a prompt left it stays open.
    Runs that hold enough of the prompt fill a sequence alone."""
    tokens, segments, loss = limits
    body = min(tokens, loss + 1)
    fill = tokens - body if segments > 1 else 0
    out, start, stop = [], 0, n
    while stop - max(prompt, start) >= body:
        filler = fill if start + fill <= prompt else 0
        out.append([(start, filler)] * (filler > 0) + [(stop - body, body)])
        start, stop = start + filler, stop - body
    while stop - start >= tokens and loss_bearing(start, tokens, prompt) <= loss:
        out.append([(start, tokens)])
        start += tokens
    return out, start, stop


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


PIECES = "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    limits: tuple[int, int, int] = LIMITS,
    group_rows: int = GROUP_ROWS,
    ids: bool = False,
) -> DataFrame:
    """Pieces of the documents' ids, placed in sequences.

    tokenizer is a byte-level BPE file (JSON or ranks) and pattern its split
    pattern. A document's ids are those of its text (a null text counts as
    empty) and end_id. A long document fills sequences of its own (see
    whole_sequences); what remains of each document is a vector (tokens, segments,
    tokens that bear loss; see loss_bearing and PROMPT_PART) and is packed in its
    group, cut where that closes a gap. All limits hold in every sequence. Rows with the same key are separate documents, rows equal in
    all too; an empty table gives no pieces; null keys are kept as null.
    ids=True adds the piece's ids (array of int). Other columns are not read."""
    kept = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    groups = max(1, -(-docs.select(F.lit(1)).count() // group_rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            rows = []
            ids_of_all, ends = text_encoder(tokenizer, pattern).encode([t or "" for t in part.column(1).to_pylist()])
            begin = 0
            for k, end in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                own = np.append(ids_of_all[begin:end], end_id).astype("<u4")
                begin = end
                whole, start, stop = whole_sequences(len(own), len(own) // PROMPT_PART, limits)
                pieces = [own[a : a + n] for sequence in whole for a, n in sequence]
                head = np.concatenate(pieces).tobytes() if ids and pieces else None
                rows.append((k, len(own), [_crc(x) for x in pieces], own[start:stop].tobytes(), head))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, part.column(2)], names=["key", "n", "crcs", "rest", "head", "row"])

    def pack(group: pa.Table) -> pa.Table:
        number = group.column("grp")[0].as_py()
        group = group.sort_by([("key", "ascending"), ("n", "ascending"), ("rest", "ascending")])
        keys, ns = group.column("key").to_pylist(), group.column("n").to_pylist()
        # The same cuts as where the ids were: they depend on the number of ids alone.
        wholes, begins, _ = zip(*(whole_sequences(n, n // PROMPT_PART, limits) for n in ns), strict=True)
        rest = [np.frombuffer(x, dtype="<u4") for x in group.column("rest").to_pylist()]
        lengths = np.array([len(x) for x in rest])
        rows = np.nonzero(lengths)[0]
        # What is left of a document is counted from where it begins.
        prompts = [max(0, n // PROMPT_PART - begin) for n, begin in zip(ns, begins, strict=True)]
        demand = np.array([(lengths[i], 1, loss_bearing(0, int(lengths[i]), prompts[i])) for i in rows], dtype=np.float64).reshape(-1, 3)
        bins = [[(int(rows[i]), 0, int(lengths[rows[i]])) for i in b] for b in dot_product_packing(demand, np.array(limits))]
        out, seq = [], number << 32
        for i, (whole, crcs, head) in enumerate(zip(wholes, group.column("crcs").to_pylist(), group.column("head").to_pylist(), strict=True)):
            crc, at = iter(crcs), 0
            for sequence in whole:
                offset = 0
                for start, length in sequence:
                    piece = np.frombuffer(head, dtype="<u4")[at : at + length].tolist() if ids else None
                    out.append((keys[i], start, length, next(crc), ns[i], seq, offset, piece))
                    offset, at = offset + length, at + length
                seq += 1
        for own in close_gaps(bins, limits, prompts):
            offset = 0
            for i, start, length in own:
                piece = rest[i][start : start + length]
                out.append((keys[i], begins[i] + start, length, _crc(piece), ns[i], seq, offset, piece.tolist() if ids else None))
                offset += length
            seq += 1
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        names = [x.split()[0] for x in PIECES.split(", ")]
        table = pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols[:7], strict=True)})
        return table.append_column("ids", pa.array(cols[7], pa.list_(pa.int32()))) if ids else table

    # The number of a row in its partition parts rows that are equal in all.
    kept = kept.withColumn("row", F.monotonically_increasing_id())
    dealt = kept.mapInArrow(cut, "key long, n long, crcs array<long>, rest binary, head binary, row long").withColumn(
        "grp", F.pmod(F.xxhash64("key", F.crc32("rest"), "row"), F.lit(groups))
    ).drop("row")
    out = dealt.groupBy("grp").applyInArrow(pack, PIECES + (", ids array<int>" if ids else ""))
    return out.withColumnRenamed("key", key)


def pack_examples(
    examples: DataFrame, sizes: list[str], limits: list[float], *, key: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """key and bin (long) for examples that have their demands in the columns sizes.

    An example above a limit in any dimension gets a bin of its own; null
    demands count as 0. Rows with the same key may lie in different bins."""
    groups = max(1, -(-examples.select(F.lit(1)).count() // group_rows))
    kind = examples.schema[key].dataType.simpleString()

    def pack(group: pa.Table) -> pa.Table:
        demand = np.stack([group.column(f"s{i}").to_numpy() for i in range(len(sizes))], axis=1)
        fits = (demand <= np.array(limits)).all(axis=1)
        where = np.zeros(len(demand), dtype=np.int64)
        seq = group.column("grp")[0].as_py() << 32
        small = np.nonzero(fits)[0]
        for own in dot_product_packing(demand[small], np.array(limits)):
            where[small[own]] = seq
            seq += 1
        alone = np.nonzero(~fits)[0]
        where[alone] = seq + np.arange(len(alone))
        return pa.table({"key": group.column("key"), "bin": where})

    picked = examples.select(
        F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(sizes)]
    )
    salted = picked.withColumn("grp", F.pmod(F.xxhash64(*picked.columns), F.lit(groups)))
    return salted.groupBy("grp").applyInArrow(pack, f"key {kind}, bin long").withColumnRenamed("key", key)
