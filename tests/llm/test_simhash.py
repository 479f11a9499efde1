import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash as S
from tidemark.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    up = {k: k for k in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {k: root(k) for k in prints}


@pytest.mark.parametrize("text", ["", "a", "A b", "one two three", "Été ÉTÉ x Y z\x0bw", "x " * 900, "\t\n"])
def test_fingerprint(text):
    assert S.text_fingerprint(text.encode()) == plain_fingerprint(text)


def test_every_pair_within_one_bit_shares_an_anchor():
    rng = np.random.default_rng(1)
    half = rng.integers(0, 2**32, 300, dtype=np.uint64)
    for bit in [None, *range(32)]:
        other = half if bit is None else half ^ np.uint64(1 << bit)
        own, near = set(zip(*map(np.ndarray.tolist, S.half_anchors(half)), strict=True)), set(zip(*map(np.ndarray.tolist, S.half_anchors(other)), strict=True))
        assert {r for r, _ in own & near} == set(range(300))
    row, anchor = S.half_anchors(half)
    assert np.bincount(row).max() <= 17
    assert (np.bitwise_count(half[row] ^ anchor) <= 2).all()


@pytest.mark.parametrize("part", [8, 2048])
def test_links_match_brute_force(spark, part):
    rng = np.random.default_rng(part)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    crowd = base[0] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    chain = [base[1]]
    for b in range(40):
        chain.append(chain[-1] ^ np.uint64(0b111 << (b % 60)))
    noisy = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 7), replace=False))) for b in base for _ in range(4)]
    fps = sorted({int(x) for x in [*base, *crowd, *chain, *noisy, np.uint64(0), np.uint64(2**64 - 1)]})
    want = plain_components({f: f for f in fps})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    roots = components(S.linked(df, part=part)).collect()
    got = {f: f for f in fps} | {int(np.int64(r.node).view(np.uint64)): int(np.int64(r.root).view(np.uint64)) for r in roots}
    classes = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    assert classes(got) == classes(want)


def test_components_of_shapes(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame([*path, *star, (5, 5), (5000, 5001), (5001, 5000), (None, 7)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1300)}) == 1
    assert len(set(got.values())) == 3 and len(got) == 201 + 300 + 2
    assert components(df.filter(F.lit(False))).count() == 0


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base.upper(), base + " end", base.replace("w150", "x"), None, "", " ", "other words here now", "q" * 50000, base]
    docs = spark.createDataFrame([(10 - i, t, 3, 4) for i, t in enumerate(texts)], "doc_id long, text string, fp int, component_id int")
    out = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    prints = {10 - i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {k: int(np.int64(r.fp).view(np.uint64)) for k, r in out.items()} == prints
    assert {k: r.component_id for k, r in out.items()} == plain_components(prints)
    assert S.near_duplicates(docs.filter(F.lit(False))).count() == 0
