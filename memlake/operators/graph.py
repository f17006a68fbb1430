"""Entity graph: hierarchies, redirects, co-occurrence priors, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.relational import mirrored, pair_counts, top_per_group
from memlake.session import stored


def climb(edges: DataFrame, child: str, parent: str, hops: int = 6) -> DataFrame:
    """(node, ancestor, depth) up to ``hops`` steps; a path never visits a node twice.

    Each hop is one equi-join of the frontier with the edges, so a hop shuffles what has not reached a root yet.
    """
    step = edges.select(F.col(child).alias("node"), F.col(parent).alias("next")).filter("next is not null").distinct()
    frontier = step.select("node", F.col("next").alias("ancestor"), F.lit(1).alias("depth"), F.array("node", "next").alias("path")).filter("node != ancestor")
    out = frontier
    for depth in range(2, hops + 1):
        up = step.select(F.col("node").alias("ancestor"), "next")
        frontier = (
            frontier.join(up, "ancestor")
            .filter(~F.array_contains("path", F.col("next")))
            .select("node", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("path", F.array("next")).alias("path"))
        )
        out = out.unionByName(frontier)
    return out.drop("path").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def resolve_redirects(merges: DataFrame, node: str, target: str, hops: int = 12) -> DataFrame:
    """(node, canonical): where each node's chain of merges ends, within ``hops``; a cycle or longer chain has none."""
    links = merges.select(F.col(node).alias("node"), F.col(target).alias("target"))
    reached = links.select("node", F.coalesce("target", "node").alias("canonical"))
    after = links.select(F.col("node").alias("canonical"), F.col("target").alias("hop"))
    length = 1
    # pointer doubling: the table of k hops joined with itself has 2 k
    while length < hops:
        both = reached.join(reached.select(F.col("node").alias("canonical"), F.col("canonical").alias("hop")), "canonical", "left")
        reached = both.select("node", F.coalesce("hop", "canonical").alias("canonical"))
        length *= 2
    ends = reached.join(after, "canonical", "left")
    return ends.select("node", F.when(F.col("hop").isNull(), F.col("canonical")).alias("canonical"))


def more_specific(places: DataFrame, hierarchy: DataFrame, who: str, place: str) -> DataFrame:
    """(who, place) for which the same one has another place below it. hierarchy: node, ancestor."""
    below = hierarchy.select(F.col("node").alias("lower"), F.col("ancestor").alias(place))
    peers = places.select(who, F.col(place).alias("lower")).distinct()
    return places.join(below, place).join(peers, [who, "lower"], "left_semi").select(who, place).distinct()


def correlation(accepted: Column, events: Column, scenes: Column) -> Column:
    total = F.least(events + scenes + accepted, F.lit(6))
    # in exact decimals, then rounded half up
    exact = accepted * F.lit("0.36").cast("decimal(4,2)") + events * F.lit("0.24").cast("decimal(4,2)") + scenes * F.lit("0.12").cast("decimal(4,2)") + total * F.lit("0.07").cast("decimal(4,2)")
    return F.least(F.lit(1.0), F.round(exact, 3).cast("double"))


def priors(events: tuple[DataFrame, str, str], scenes: tuple[DataFrame, str, str], accepted: tuple[DataFrame, str, str]) -> DataFrame:
    """Co-occurrence evidence of each pair from three sources, with its correlation. A source: rows, group column, member column."""
    found = pair_counts(events=events, scenes=scenes, accepted=accepted)
    return found.withColumn("correlation", correlation(F.col("accepted"), F.col("events"), F.col("scenes")))


def strongest_neighbours(edges: DataFrame, weight: str, n: int = 5) -> DataFrame:
    """The n strongest neighbours of each node, both directions counted."""
    both = mirrored(edges.select("a", "b", weight))
    return top_per_group(both, ["a"], [F.desc(weight), F.asc("b")], n, "rank")


def shared_neighbours(edges: DataFrame, node: str, neighbour: str, least: int = 2) -> DataFrame:
    """Node pairs with at least ``least`` common neighbours."""
    return pair_counts(shared=(stored(edges.select(neighbour, node), "edges"), neighbour, node)).filter(F.col("shared") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    return mirrored(edges.select("a", "b")).groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("b").alias("neighbours"))


def upsert_weights(stored: DataFrame, new: DataFrame, low: float = 0.05, high: float = 5.0) -> DataFrame:
    """Edges after an upsert that keeps the larger weight, clamped."""
    both = stored.select("a", "b", F.col("weight").alias("old")).join(new.select("a", "b", F.col("weight").alias("new")), ["a", "b"], "full_outer")
    return both.select("a", "b", F.greatest(F.lit(low), F.least(F.lit(high), F.greatest("old", "new"))).alias("weight"))


def reinforce(retrieved: DataFrame, query: str, item: str, rank: str, top: int = 6, start: float = 0.55, step: float = 0.08, cap: float = 2.5) -> DataFrame:
    """Weights of edges between items retrieved together: a start weight and a step for each further query, capped."""
    pairs = pair_counts(n=(stored(retrieved.filter(F.col(rank) <= top).select(query, item), "retrieved"), query, item))
    return pairs.select("a", "b", F.round(F.least(F.lit(cap), start + step * (F.col("n") - 1)), 4).alias("weight"))


def reach(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, distance) within ``hops`` steps along undirected edges."""
    step = mirrored(edges.select("a", "b")).distinct().select(F.col("a").alias("node"), F.col("b").alias("next"))
    frontier = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"))
    out = frontier
    for distance in range(1, hops + 1):
        frontier = frontier.join(step, "node").select("seed", F.col("next").alias("node"), F.lit(distance).alias("distance")).distinct()
        frontier = frontier.join(out.select("seed", "node"), ["seed", "node"], "left_anti")
        out = out.unionByName(frontier)
    return out


def expand_down(edges: DataFrame, seeds: DataFrame, parent: str, child: str, budget: int, levels: int = 16) -> DataFrame:
    """seed, node, distance of what lies below each seed of a graph of summaries, nearest first, up to ``budget`` nodes a seed.

    Level by level: the frontier meets the edges, what a seed has seen already (a shared descendant, a cycle) is left out, and of
    a level that the budget cannot hold the first nodes stay. seeds: seed (the seed is not counted itself).
    """
    step = edges.select(F.col(parent).alias("node"), F.col(child).alias("next")).filter("node is not null and next is not null").distinct()
    seen = stored(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")).distinct(), "expanded")
    frontier = seen
    for distance in range(1, levels + 1):
        reached = frontier.join(step, "node").select("seed", F.col("next").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        used = seen.groupBy("seed").agg((F.count(F.lit(1)) - 1).alias("used"))
        nth = F.row_number().over(Window.partitionBy("seed").orderBy("node"))
        kept = top_per_group(reached, ["seed"], [F.asc("node")], budget).withColumn("nth", nth).join(used, "seed").filter(F.col("nth") + F.col("used") <= budget)
        frontier = stored(kept.select("seed", "node", F.lit(distance).alias("distance")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("distance > 0")
