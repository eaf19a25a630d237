"""Connected components of an undirected edge list, by alternating large-star and small-star steps.

Each step groups edges by one end and links its neighbours to the smallest, so the work per
round is a shuffle of the edges; the number of rounds grows with the logarithm of the longest
chain. A node with very many neighbours is no hot group: its smallest neighbour is a
map-side minimum, and the links are made by a join that adaptive execution may split.
Each round is cut off through the shared checkpoint folder.

Null ends and self-loops are ignored; an empty list gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over directed rows (a, b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str, limit: int = 60) -> DataFrame:
    """(node, root) of every node on an edge; the root is the component's smallest node."""
    now = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct())
    before = None
    for _ in range(limit):
        now = cut(_star(_star(now, large=True), large=False))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
