"""Chains of links: where each node's chain ends, how far that is, and which chains never end.

Ranks come by pointer doubling: in each round a node's pointer jumps to where the
node that it points to points, so a chain of n links takes log2(n) rounds,
whatever the order of its nodes; each round is one join of all nodes with those
that they point to. Nodes whose pointers still go on after as many rounds as the number
of nodes asks for go round in a cycle, or lead into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked_chains(links: DataFrame, node: str, successor: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """node, last, steps, status of every node of links (one row a node; successor is null at an end).

    status: "ends" if the chain comes to a node without a successor, last, after
    steps links; "breaks" if last names a successor that isn't there; "cycles" if
    it comes to no end: last and steps are null. Rows without a node are left out;
    of rows that repeat a node the one with the smallest successor stays.

    keep stores a table under a name and gives it back: each round starts from files."""
    plain = links.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(successor).alias("next"))
    there = plain.select(F.col("node").alias("next"), F.lit(True).alias("there"))
    start = plain.join(there, "next", "left").select(
        "node", F.when(F.col("there"), F.col("next")).alias("to"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps"), F.when(F.col("there").isNull(), F.col("node")).alias("last"), (F.col("next").isNotNull() & F.col("there").isNull()).alias("breaks")
    )
    state = keep(start, "chains-0")
    nodes = state.count()
    for turn in range(1, max(1, nodes).bit_length() + 1):
        open_ones = state.filter("to IS NOT NULL")
        if open_ones.isEmpty():
            break
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("last").alias("last2"), F.col("breaks").alias("breaks2"))
        jumped = open_ones.join(ahead, "to").select("node", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("last2").alias("last"), F.col("breaks2").alias("breaks"))
        state = keep(state.filter("to IS NULL").unionByName(jumped), f"chains-{turn}")
    going = F.col("to").isNotNull()
    status = F.when(going, "cycles").when(F.col("breaks"), "breaks").otherwise("ends")
    return state.select(F.col("node").alias(node), F.when(~going, F.col("last")).alias("last"), F.when(~going, F.col("steps")).alias("steps"), status.alias("status"))


def positions(ranked: DataFrame) -> DataFrame:
    """ranked with position: how many links a node is behind the head of the longest chain to its last node."""
    longest = ranked.groupBy("last").agg(F.max("steps").alias("_most"))
    return ranked.join(longest, "last", "left").withColumn("position", F.col("_most") - F.col("steps")).drop("_most")
