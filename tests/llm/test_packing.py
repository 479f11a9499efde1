import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from tidemark.llm import packing as K  # noqa: E402


def loss_of(pieces):
    """Ids that bear loss, counted one by one."""
    return sum(sum(i >= r.doc_tokens // 8 and i > r.start for i in range(r.start, r.start + r.length)) for r in pieces)


def check_pieces(rows, texts, limits=K.LIMITS):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    ids = {k: tok.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(texts)
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[k])
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits[0] and len(own) <= limits[1]
        assert loss_of(own) <= limits[2]
        padding += 0 if at & (at - 1) == 0 else limits[0] - at
    return padding, sum(map(len, ids.values()))


def test_pieces_cover_documents(spark):
    texts = {i: ("word the " * (i * 37 % 900)).strip() for i in range(300)} | {1000: None, 1001: "", 1002: "x" * 30000}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, sequence_id int")
    rows = K.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    padding, total = check_pieces(rows, texts)
    assert padding < 0.02 * total
    assert K.pack_documents(docs.filter(F.lit(False)), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_limits_on_segments_hold(spark):
    texts = {i: "a" for i in range(500)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    limits = (64, 4, 60)
    rows = K.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, limits=limits, group_rows=100).collect()
    check_pieces(rows, texts, limits)


@pytest.mark.parametrize("which", [0, 1, 2])
def test_each_limit_binds(spark, which):
    texts = {i: "a" for i in range(600)} if which == 1 else {i: ("word the " * (760 if which == 2 else 150 + i % 90)).strip() for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    measure = [lambda own: sum(r.length for r in own), len, loss_of][which]
    most = {}
    for name, limits in (("set", K.LIMITS), ("free", tuple(4096 if i in ((0, 2) if which == 0 else (which,)) else x for i, x in enumerate(K.LIMITS)))):
        by_seq = defaultdict(list)
        for r in K.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, limits=limits).collect():
            by_seq[r.sequence_id].append(r)
        most[name] = max(measure(own) for own in by_seq.values())
    assert most["set"] <= K.LIMITS[which] < most["free"]


@pytest.mark.parametrize("limits", [K.LIMITS, (64, 4, 60), (64, 4, 20), (64, 1, 60), (64, 16, 64), (1024, 2, 1)])
def test_whole_sequences_hold_all_limits(limits):
    for n in [0, 1, 60, 64, 65, 1000, 1024, 1025, 1098, 2047, 20000]:
        for prompt in (0, n // 8, n // 2, n):
            whole, start, stop = K.whole_sequences(n, prompt, limits)
            pieces = sorted(x for own in whole for x in own) + [(start, stop - start)]
            at = 0
            for a, length in sorted(pieces):
                assert a == at and (length > 0 or a == start)
                at += length
            assert at == n and stop - start < max(limits[0], limits[2] + 1)
            for own in whole:
                assert len(own) <= limits[1] and sum(x[1] for x in own) <= limits[0] and sum(K.loss_bearing(a, m, prompt) for a, m in own) <= limits[2]
            assert K.loss_bearing(start, stop - start, prompt) <= limits[2]


def test_long_documents_fill_sequences_but_for_little(spark):
    rng = np.random.default_rng(0)
    texts = {i: ("word the " * int(rng.integers(1, 4000))).strip() for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    padding, total = check_pieces(K.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, ids=True).collect(), texts)
    assert padding < 0.02 * total


def test_repeated_and_keyless_rows_are_packed_each(spark):
    rows = [(7, "one two three")] * 40 + [(7, "four")] + [(None, "five six"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = K.pack_documents(docs, P.path("byte_bpe_50k.json"), P.PATTERN, group_rows=8, ids=True).collect()
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in out) == want == sum(len(r.ids) for r in out)
    assert sum(r.length for r in out if r.doc_id is None) == 2 + sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in ["five six"])
    assert len({r.sequence_id >> 32 for r in out}) > 3  # equal rows don't make one group


def test_heuristic_respects_every_limit_and_is_near_the_bound():
    rng = np.random.default_rng(3)
    sizes = np.stack([rng.integers(1, 600, 800), np.ones(800), rng.integers(0, 300, 800)], axis=1)
    limits = np.array([1024, 8, 500])
    bins = K.dot_product_packing(sizes, limits)
    assert sorted(i for b in bins for i in b) == list(range(800))
    assert all((sizes[b].sum(axis=0) <= limits).all() for b in bins)
    assert len(bins) <= 1.15 * (sizes.sum(axis=0) / limits).max()
    assert K.dot_product_packing(np.zeros((0, 3)), limits) == []


def test_examples_with_columns_of_demands(spark):
    rows = [(i, 100 + i % 7, 1, i % 50) for i in range(400)] + [(9999, 5000, 1, 0), (10000, None, None, None)]
    df = spark.createDataFrame(rows, "id long, tokens int, segs int, loss int")
    out = K.pack_examples(df, ["tokens", "segs", "loss"], [1024, 10, 200], key="id").collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    own = defaultdict(list)
    for r in out:
        own[r.bin].append(r.id)
    size = {r[0]: [x or 0 for x in r[1:]] for r in rows}
    for ids in own.values():
        total = np.array([size[i] for i in ids]).sum(axis=0)
        assert ids == [9999] or (total <= [1024, 10, 200]).all()
