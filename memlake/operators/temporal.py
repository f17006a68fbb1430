"""Time rollups: a tree of day, week, month and year nodes over an event log, and what hangs on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions.scalar import day_part
from memlake.operators.relational import container_of, top_per_group

LAYERS = ("day", "week", "month", "year")
PARENT = {"day": "week", "week": "month", "month": "year"}


def bucketed(events: DataFrame, ts: str, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Each event once a layer, with ``layer`` and ``bucket`` (first day of the bucket): one pass for all layers."""
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.to_date(F.date_trunc(x, F.col(ts))).alias("bucket")) for x in layers]))
    return events.withColumn("b", each).select("*", "b.layer", "b.bucket").drop("b")


def rollup(events: DataFrame, ts: str, entity: str, kind: str, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    return (
        bucketed(events, ts, layers)
        .groupBy("layer", "bucket")
        .agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct(entity).alias("n_entities"), F.countDistinct(kind).alias("n_kinds"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    )


def top_kinds(events: DataFrame, ts: str, kind: str, n: int = 3, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    counts = bucketed(events, ts, layers).groupBy("layer", "bucket", kind).agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["layer", "bucket"], [F.desc("n"), F.asc(kind)], n, "rank")


def nodes(events: DataFrame, ts: str, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """node_id, layer, start_day, end_day (inclusive) of every bucket that has events."""
    last = F.when(F.col("layer") == "day", F.col("bucket")).when(F.col("layer") == "week", F.date_add("bucket", 6)).when(F.col("layer") == "month", F.last_day("bucket")).otherwise(F.make_date(F.year("bucket"), F.lit(12), F.lit(31)))
    seen = bucketed(events, ts, layers).select("layer", "bucket").distinct()
    return seen.select(F.concat_ws(":", "layer", F.date_format("bucket", "yyyy-MM-dd")).alias("node_id"), "layer", F.col("bucket").alias("start_day"), last.alias("end_day"))


def parent_links(tree: DataFrame) -> DataFrame:
    """node_id, parent_id: the node of the next layer that contains the node; a week across two months has none."""
    parents = F.create_map(*[F.lit(x) for pair in PARENT.items() for x in pair])
    inner = tree.withColumn("parent_layer", parents[F.col("layer")]).filter("parent_layer is not null")
    outer = tree.withColumnRenamed("layer", "parent_layer")
    return container_of(inner, outer, ["parent_layer"]).select("node_id", "parent_id")


def weekly_routines(events: DataFrame, ts: str, who: list[str], until: Column, days: int = 90, weeks: int = 3) -> DataFrame:
    """What recurs on a weekday and part of day in at least ``weeks`` distinct weeks of the last ``days`` days."""
    recent = events.filter((F.col(ts) > until - F.make_interval(days=F.lit(days))) & (F.col(ts) <= until))
    grouped = recent.groupBy(*who, F.weekday(ts).alias("weekday"), day_part(F.col(ts)).alias("day_part"))
    found = grouped.agg(F.countDistinct(F.date_trunc("week", ts)).alias("n_weeks"), F.count(F.lit(1)).alias("n_events"))
    return found.filter(F.col("n_weeks") >= weeks)


def archival(tree: DataFrame, today: Column, days: dict[str, int]) -> DataFrame:
    """Nodes with their age and whether it passed their layer's limit."""
    limits = F.create_map(*[F.lit(x) for pair in days.items() for x in pair])
    age = F.datediff(today, F.col("end_day"))
    return tree.select("node_id", "layer", age.alias("age_days"), (age >= limits[F.col("layer")]).alias("archive"))


def carry_forward(df: DataFrame, group: str, order: str, value: str) -> Column:
    """The last known value up to this row."""
    from pyspark.sql import Window

    return F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
