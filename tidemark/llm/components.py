"""Connected components of a graph of links, by contraction in DataFrame joins.

Each round gives every node the neighbour (or itself) that comes first in an
order drawn anew from a hash, and replaces nodes by what they point to. Hooked
nodes leave the graph, so its size falls by a constant factor a round whatever
its shape. Aggregates combine before they shuffle and joins are of many links to one
row a node, which AQE can split, so a hub with millions of links stays spread
out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of links (columns a, b of one type).

    Nodes share a root exactly if links join them; the root is one of them.
    Links to oneself and repeated links do no harm, links with a null end are
    ignored; no links give no rows."""
    edges = stored(links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    hops = []
    for turn in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        order = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("id"))
        nearest = both.groupBy("node").agg(F.min(order(F.col("near"))).alias("near"))
        hop = stored(nearest.select("node", F.least("near", order(F.col("node")))["id"].alias("to")))
        hops.append(hop)
        a = hop.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = hop.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(a, "a").select("ta", "b").distinct().join(b, "b").filter("ta <> tb")
        edges = stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    else:
        raise RuntimeError(f"links are left after {most_rounds} rounds")
    if not hops:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).filter(F.lit(False))
    root = hops[-1].select("node", F.col("to").alias("root"))
    for hop in reversed(hops[:-1]):
        later = root.select(F.col("node").alias("to"), F.col("root").alias("next"))
        root = stored(hop.join(later, "to", "left").select("node", F.coalesce("next", "to").alias("root")))
    return root
