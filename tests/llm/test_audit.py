import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

from tidemark.llm import audit as A

SCHEMA = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def masks(docs):
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    for k, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)), k is not None and k > least[t]]
        yield k, s or "", fails


def brute(docs, labels):
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    out, total = {}, defaultdict(int)
    rows = list(masks(docs))
    for part in {s for _, s, _ in rows}:
        mine = [(k, f) for k, s, f in rows if s == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                i = "ABCDE".index(letter)
                gone, left = [x for x in left if x[1][i]], [x for x in left if not x[1][i]]
                failing = sum(f[i] for _, f in mine)
                only = sum(f[i] and sum(f) == 1 for _, f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), only, sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
                total[part, letter] += len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def sample(n, seed):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        words = rng.choice([[str(x) for x in range(250)], ["a", "b"] * 150, ["Word", "x y"], [], ["CAPS"] * 3 + [str(x) for x in range(300)]])
        text = rng.choice([" ", "\n", "\t\x0b "]).join(words) + rng.choice(["", "", " #", " |", " "])
        docs.append((i, rng.choice([text, text, None, ""]), rng.choice(["s", "t", None])))
    return docs


def test_all_orders_against_brute_force(spark):
    docs = sample(60, 1) + [(3, "same key, other text", "s"), (3, "same key, other text", "t"), (None, "", "s"), (None, None, "s"), (2, "", "t"), (99, "long " * 30000, "s")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 50)] + [(3, None, 1), (3, 1, None), (None, 1, 1), (500, 1, 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    got = found(A.interactions(df, spark.createDataFrame(labels, LABELS)))
    assert got == brute(docs, labels) and len(got) == 3 * 600


def test_clashing_columns_and_empty_tables(spark):
    docs, labels = sample(20, 2), [(1, 1, 0)]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], SCHEMA + ", mask int, part int, salt int, good int")
    assert found(A.interactions(df, spark.createDataFrame(labels, LABELS))) == brute(docs, labels)
    assert found(A.interactions(df, spark.createDataFrame([], LABELS))) == brute(docs, [])
    assert A.interactions(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS)).count() == 0


def test_one_text_in_most_documents(spark):
    docs = [(i, "alike", "hot") for i in range(400)] + [(400 + i, f"other {i}", "hot") for i in range(9)]
    got = found(A.interactions(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], LABELS)))
    assert got["hot", "EABCD", 1][:4] == (10, 399, 0, 0)


def test_least_squares_gives_shapley_values_exactly():
    rng = random.Random(3)
    for n in (2, 3, 5):
        v = [Fraction(rng.randrange(-50, 99)) for _ in range(2**n)]
        mean = [Fraction(0)] * n
        orders = list(permutations(range(n)))
        for order in orders:
            seen = 0
            for i in order:
                mean[i] += Fraction(v[seen | 1 << i] - v[seen], len(orders))
                seen |= 1 << i
        assert [sum(a * b for a, b in zip(row, v, strict=True)) for row in A.shapley_combinations(n)] == mean
