"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Links stay in DataFrames; what each half of a round finds is written to the shared folder. A hub's links are not
gathered: the smallest neighbour is an aggregate with partial results, and as it is a table of its own by the time of
the join, Spark can broadcast it while it is small and split the join where one node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import stored


def _with_smallest(pairs: DataFrame) -> DataFrame:
    """(node, other) with the smallest of the node and all its others."""
    smallest = stored(pairs.groupBy("node").agg(F.min("other").alias("m")), "components-smallest")
    return pairs.join(smallest, "node").select("node", "other", F.least("m", "node").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour is linked to the smallest one."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return _with_smallest(both).filter("other > node").select(F.col("other").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node itself, is linked to the smallest one."""
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    found = _with_smallest(down)
    moved = found.filter("other != m").select(F.col("other").alias("a"), F.col("m").alias("b"))
    return moved.union(found.select(F.col("node").alias("a"), F.col("m").alias("b")).distinct())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node. Links: columns a, b."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges = stored(edges, "components-links")
    for _ in range(max_rounds):
        after = stored(_small_star(_large_star(edges)).filter("a != b").distinct(), "components-links")
        # at the fixed point every node is linked to its component's smallest node alone
        state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        done = state(after) == state(edges)
        edges = after
        if done:
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(edges.select("b", "b").distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
