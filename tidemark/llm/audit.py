"""Operator 13: how filters interact, from one tabulation of what their coalitions remove.

Every document gets a mask of the filters that it fails. A part's counts by mask
say how many documents each of the 32 coalitions of filters removes: those whose
mask meets it. Everything else follows from these 32 numbers. A step of an order
removes the difference between the coalition of its filters so far and the one
before; what fails a filter alone is what the whole coalition loses without it.

Shapley values are the exact solution of a constrained least squares problem:
coalitions weigh by the Shapley kernel, and the values have to sum to what all
filters remove together. Its normal equations are solved once, in rationals, for
all right-hand sides, which gives each filter's value as a fixed combination of
the coalitions' numbers.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spaces, which part words; and the capitals and symbols that filters look for.
SPACES, CAPITALS, SYMBOLS = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[#$%&*|]"
#: Ways to deal documents of one text, or one key, for a join.
SALTS = 32


def solve(a: list[list[Fraction]], b: list[list[Fraction]]) -> list[list[Fraction]]:
    """x of a x = b, exactly; b has a column for each right-hand side."""
    n = len(a)
    rows = [[*map(Fraction, p), *map(Fraction, q)] for p, q in zip(a, b, strict=True)]
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [r[n:] for r in rows]


def shapley_combinations(n: int) -> list[list[Fraction]]:
    """For each of n players the combination of the 2 ** n coalitions' numbers that is its Shapley value.

    Least squares of v(S) - v({}) against the sum of the values in S, over all S
    but the empty and the full one, weighed by the Shapley kernel, with the sum of
    all values held at v(all) - v({}) by a multiplier."""
    full = 2**n - 1
    has = lambda s, i: s >> i & 1
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    normal = [[sum((w for s, w in weight.items() if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] for i in range(n)]
    matrix = [[*row, Fraction(1)] for row in normal] + [[Fraction(1)] * n + [Fraction(0)]]
    right = [[Fraction(0)] * (full + 1) for _ in range(n + 1)]
    for i in range(n):
        for s, w in weight.items():
            if has(s, i):
                right[i][s] += w
                right[i][0] -= w
    right[n][full], right[n][0] = Fraction(1), Fraction(-1)
    return solve(matrix, right)[:n]


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails each of the filters A to D, by its own."""
    words = F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, CAPITALS, ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals > 2 * F.char_length(text), text.rlike(SYMBOLS)]


def failures(docs: DataFrame, *, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """key, part and mask for every document; bit i of the mask is set if it fails filter i of A to E.

    E fails if a smaller key has the same text (the same SHA-256) anywhere in
    docs. A null text is empty, a null part is an empty string. A document
    without a key is no other's copy, nor is another one its: it never fails E.
    Rows that repeat a key are documents each, and no copies of each other."""
    body = F.coalesce(F.col(text), F.lit(""))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(text_failures(body))), F.lit(0))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.sha2(body.cast("binary"), 256).alias("sha"))
    firsts = rows.filter("key IS NOT NULL").groupBy("sha").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    # Copies of one text are dealt by their keys; only texts that have copies are in the other side.
    firsts = firsts.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(firsts, ["sha", "salt"], "left")
    copy = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    return both.select("key", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), "sha")


def _flagged(failed: DataFrame, labels: DataFrame, key: str, good: str, toxic: str) -> DataFrame:
    """failed with good and toxic from the labels of its key: true if any of the key's rows says so."""
    marks = labels.filter(F.col(key).isNotNull() & ((F.col(good) == 1) | (F.col(toxic) == 1)))
    marks = marks.groupBy(F.col(key).alias("key")).agg(F.max(F.coalesce(F.col(good) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic) == 1, F.lit(False))).alias("toxic"))
    marks = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(3))))
    both = failed.withColumn("salt", F.pmod(F.xxhash64("sha", "part"), F.lit(4)).cast("int")).join(marks, ["key", "salt"], "left")
    return both.withColumns({x: F.coalesce(x, F.lit(False)) for x in ("good", "toxic")})


def coalitions(masked: DataFrame, filters: int) -> DataFrame:
    """part, n (documents), and how many of all, good and toxic documents each coalition of filters removes:
    arrays removed, good_removed, toxic_removed, a coalition's number being its filters' bits."""
    size = 2**filters
    cells = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cell = F.struct("mask", "n", "good", "toxic")
    parts = cells.groupBy("part").agg(F.collect_list(cell).alias("cells"))  # at most 2 ** filters a part
    total = lambda name, s: F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(x["mask"].bitwiseAND(F.lit(s)) != 0, x[name]).otherwise(0))
    tables = {out: F.array(*[total(name, s) for s in range(size)]) for out, name in (("removed", "n"), ("good_removed", "good"), ("toxic_removed", "toxic"))}
    return parts.select("part", F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), *[v.alias(k) for k, v in tables.items()])


def step_counts(tables: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, from the coalitions' numbers."""
    n, full = len(letters), 2 ** len(letters) - 1
    orders = factorial(n)
    combinations = shapley_combinations(n)
    whole = [[x * orders for x in row] for row in combinations]
    assert all(x.denominator == 1 for row in whole for x in row)
    value = lambda name, s: F.element_at(name, s + 1)
    sums = F.array(*[sum((int(x) * value("removed", F.lit(s)) for s, x in enumerate(row) if x), F.lit(0).cast("long")) for row in whole])
    steps = []
    for order in permutations(range(n)):
        name = "".join(letters[i] for i in order)
        for k, i in enumerate(order):
            before = sum(1 << j for j in order[:k])
            steps.append((name, k + 1, i, before))
    plan = F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"f":{f},"own":{1 << f},"b":{b}}}' for o, s, f, b in steps) + "]"), "array<struct<o:string,s:int,f:int,own:int,b:int>>")
    rows = tables.withColumn("_sums", sums).select("*", F.inline(plan))
    own, before = F.col("own"), F.col("b")
    after = before + own
    gone = lambda name: value(name, after) - value(name, before)
    return rows.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), (F.col("n") - value("removed", after)).alias("kept"), gone("removed").alias("removed"),
        (value("removed", own) - gone("removed")).alias("redundant"), (value("removed", F.lit(full)) - value("removed", full - own)).alias("unique_fails"),
        gone("good_removed").alias("good_lost"), gone("toxic_removed").alias("toxic_lost"), F.element_at("_sums", F.col("f") + 1).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", part: str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
    (a filter's removed, summed over all orders) of the filters A to E.

    See failures for nulls, empty texts and repeated rows. Labels may lack
    documents, repeat them or hold nulls: a mark counts if any row of the key has
    it. No documents give no rows; further columns don't matter."""
    failed = failures(docs, text=text, key=key, part=part)
    return step_counts(coalitions(_flagged(failed, labels, key, good, toxic), 5), "ABCDE")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, (len(ws) < 200)::INT AS a, (100 * len(list_distinct(ws)) < 50 * len(ws))::INT AS b, (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT AS c,
  regexp_matches(t, '[#$%&*|]')::INT AS d, coalesce(doc_id > least, false)::INT AS e FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS x, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
u AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS i),
o AS (SELECT p.i || q.i || r.i || s.i || t.i AS filter_order FROM u p JOIN u q ON q.i <> p.i JOIN u r ON r.i NOT IN (p.i, q.i) JOIN u s ON s.i NOT IN (p.i, q.i, r.i) JOIN u t ON t.i NOT IN (p.i, q.i, r.i, s.i)),
k AS (SELECT part, n, good, toxic, a + b + c + d + e AS fails, filter_order, step, filter_order[step] AS i,
  CASE filter_order[step] WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS own,
  (a = 1 AND position('A' IN filter_order) < step) OR (b = 1 AND position('B' IN filter_order) < step) OR (c = 1 AND position('C' IN filter_order) < step)
   OR (d = 1 AND position('D' IN filter_order) < step) OR (e = 1 AND position('E' IN filter_order) < step) AS gone
  FROM f CROSS JOIN o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
g AS (SELECT part, filter_order, step, i, coalesce(sum(n) FILTER (NOT gone AND own = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND own = 1), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND own = 1), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own = 1 AND fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND own = 1), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND own = 1), 0)::BIGINT AS toxic_lost FROM k GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM g
"""
