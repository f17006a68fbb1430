"""Read models: scored, scoped and collapsed views that answers are taken from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.relational import top_per_group


def subject_binding(subject_id_matches: Column, names_found: Column, names_asked: Column) -> Column:
    """1 by id, .85 with all names, .55 with some, 0 with none."""
    return F.when(subject_id_matches, 1.0).when((names_asked > 0) & (names_found == names_asked), 0.85).when(names_found > 0, 0.55).otherwise(0.0)


def unit_score(lexical: Column, kind: Column, ownership: Column, subject: Column, temporal: Column, cues: Column) -> Column:
    """Sum of a unit's signals: lexical, authority of its kind, ownership, subject fit, time and cues."""
    authority = F.when(kind == "turn", 1.2).when(kind == "sentence", 1.05).when(kind == "date_span", 0.96).otherwise(0.82)
    fit = F.when(subject == "same", 1.45).when(subject == "possible", 0.2).when(subject == "other", -1.2).otherwise(-0.4)
    return lexical + authority + ownership + fit + temporal + cues


def session_log_score(kind: Column, confidence: Column, n_terms: Column) -> Column:
    bonus = F.when(kind == "decision", 0.55).when(kind == "summary", 0.5).otherwise(0.45)
    return bonus + 0.35 * confidence + 0.08 * n_terms


def windowed(rows: DataFrame, ts: str, start: str, end: str, pattern: str | None = None) -> DataFrame:
    """Rows of a half-open window, optionally those whose text matches."""
    found = rows.filter((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))
    return found.filter(F.col("text").rlike(pattern)) if pattern else found


def subject_rows(sources: dict[str, DataFrame], subject: str, value: object) -> DataFrame:
    """Rows of several typed sources about one subject, with their tier; the sources share their columns."""
    out = None
    for tier, df in sources.items():
        part = df.filter(F.col(subject) == value).withColumn("tier", F.lit(tier))
        out = part if out is None else out.unionByName(part)
    return out


def merged_tenants(scored: DataFrame, tenant: str, order: list[Column], per_tenant: int, limit: int) -> DataFrame:
    """The best rows of every tenant, merged by score."""
    return top_per_group(scored, [tenant], order, per_tenant).orderBy(*order).limit(limit)


def confidence_grade(support: Column, contradicting: Column) -> Column:
    return F.when(contradicting > 0, "contradicted").when(support >= 2, "supported").when(support == 1, "weak").otherwise("missing")


def effective_time(*candidates: str) -> Column:
    return F.coalesce(*candidates)


def task_states(rows: DataFrame, key: str, ts: Column, status: str, order: str) -> DataFrame:
    """Each task's latest state by effective time, with how many states it went through."""
    timed = rows.withColumn("effective_at", ts)
    counted = Window.partitionBy(key)
    return top_per_group(timed.withColumn("n_states", F.count(F.lit(1)).over(counted)), [key], [F.desc("effective_at"), F.asc(order)]).select(key, status, "effective_at", "n_states")


def latest_source(rows: DataFrame, group: str, ts: Column, uri: str) -> DataFrame:
    """The row of the latest time in each group, ties to the larger uri."""
    return top_per_group(rows.withColumn("latest_at", ts), [group], [F.desc_nulls_last("latest_at"), F.desc(uri)])


def exact_detail(rows: DataFrame, key: str, must: str, may: str, limit: int = 80, least: int = 8, most: int = 2400) -> DataFrame:
    """Texts of fitting length that match one pattern, those that match the other too first, then in the first person."""
    found = rows.filter(F.length("text").between(least, most) & F.col("text").rlike(must))
    marked = found.withColumns({"also": F.col("text").rlike(may), "first_person": F.col("text").rlike(r"(?i)(?:^|[^a-z])(?:i|my|je|ich|yo)(?:[^a-z]|$)")})
    return marked.orderBy(F.desc("also"), F.desc("first_person"), F.asc(key)).limit(limit)


def pair_reports(rows: DataFrame, left: str, right: str, kind: str, confidence: str, order: str) -> DataFrame:
    """One row for each unordered pair and kind: the most confident."""
    both = rows.withColumns({"a": F.least(left, right), "b": F.greatest(left, right)}).filter("a != b")
    return top_per_group(both, ["a", "b", kind], [F.desc(confidence), F.asc(order)])


def bundles(rows: DataFrame, key: list[str], ts: str, granularity: Column, support: str) -> DataFrame:
    """Rows of one event gathered: how many, since when, finest granularity, most support."""
    return rows.withColumn("g", granularity).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_at"), F.max("g").alias("granularity"), F.max(support).alias("support"))


def recovery_state(mismatched: Column, mixed: Column, contradicted: Column, overlap: Column, support: Column, anchored: Column) -> Column:
    """The first rule that fits says why an answer isn't adequate yet."""
    return (
        F.when(mismatched, "mismatched_subject").when(mixed, "mixed_subject").when(contradicted, "contradicted").when(overlap == 0, "missing_overlap")
        .when(support < 2, "insufficient_support").when(~anchored, "missing_anchor").otherwise("adequate")
    )


def summary_descent(nodes: DataFrame, links: DataFrame, layers: tuple[str, ...], budgets: dict[str, int], enough: int, weight: str) -> DataFrame:
    """Nodes of a time tree from the top layer down: the best of each layer below chosen nodes, until enough are chosen.

    At most a handful of layers, so the driver decides between them by one count each.
    """
    chosen = nodes.filter(F.col("layer") == layers[0]).orderBy(F.desc(weight), "node_id").limit(budgets[layers[0]])
    out = chosen
    for layer in layers[1:]:
        if out.count() >= enough:
            break
        below = links.join(chosen.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select("node_id")
        chosen = nodes.filter(F.col("layer") == layer).join(below, "node_id", "left_semi").orderBy(F.desc(weight), "node_id").limit(budgets[layer])
        out = out.unionByName(chosen)
    return out


def blocked_writes(writes: DataFrame, locks: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Writes that no correction made after them forbids. locks: keys, locked_at."""
    held = locks.groupBy(*keys).agg(F.max("locked_at").alias("locked_at"))
    return writes.join(held, keys, "left").filter(F.col("locked_at").isNull() | (F.col(ts) > F.col("locked_at"))).drop("locked_at")


def profile_snapshot(rows: DataFrame, subject: str, kind: str, value: str, ts: str, order: str) -> DataFrame:
    """The latest value of each kind of each subject, gathered into one text a subject."""
    latest = top_per_group(rows, [subject, kind], [F.desc(ts), F.asc(order)])
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(kind).alias("k"), F.col(value).cast("string").alias("v")))), lambda x: F.concat_ws("=", x.k, x.v))
    return latest.groupBy(subject).agg(F.array_join(parts, "; ").alias("profile"), F.max(ts).alias("as_of"))
