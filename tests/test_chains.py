"""Ranks by pointer doubling against following the links one by one."""

import random

import pytest

from tidemark.operators import chains


def walk(links):
    out = {}
    for node in links:
        at, steps = node, 0
        while links.get(at) in links and links[at] is not None and steps <= len(links):
            at, steps = links[at], steps + 1
        out[node] = (None, None, "cycles") if steps > len(links) else (at, steps, "ends" if links[at] is None else "breaks")
    return out


@pytest.mark.parametrize("kind", ["random", "line", "star", "ring", "none"])
def test_all_kinds_of_links(spark, kind):
    rng = random.Random(1)
    links = {
        "random": {i: rng.choice([None, rng.randrange(240), rng.randrange(240), i + 1]) for i in range(200)},
        "line": {i: i + 1 if i < 299 else None for i in range(300)},
        "star": {i: 0 if i else 999 for i in range(100)},
        "ring": {i: (i + 1) % 64 for i in range(64)} | {100: 5, 101: 101},
        "none": {},
    }[kind]
    rows = list(links.items())
    rng.shuffle(rows)
    rounds = []

    def keep(df, name):
        rounds.append(name)
        spark.catalog.clearCache()
        return spark.createDataFrame(df.collect(), df.schema)

    df = spark.createDataFrame([*rows, (None, 3)], "n long, next long")
    found = chains.positions(chains.ranked_chains(df, "n", "next", keep)).collect()
    want = walk(links)
    assert {r.n: (r.last, r.steps, r.status) for r in found} == want
    most = {}
    for last, steps, _ in want.values():
        most[last] = max(most.get(last, 0), steps or 0)
    assert all(r.position == (None if r.last is None else most[r.last] - r.steps) for r in found)
    assert len(rounds) <= max(1, len(links)).bit_length() + 1


def test_of_repeated_nodes_one_stays(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", None), ("c", None)], "n string, next string")
    found = {r.n: r.last for r in chains.ranked_chains(df, "n", "next", lambda d, _: d).collect()}
    assert found == {"a": "b", "b": "b", "c": "c"}
