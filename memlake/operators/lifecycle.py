"""State over time: versions, decay, adjudication, overlays, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.relational import top_per_group


def versions(changes: DataFrame, key: str, state: str, ts: str, order: str) -> DataFrame:
    """Validity intervals (half-open) of each key's states; an equal state only extends the open one."""
    own = Window.partitionBy(key).orderBy(ts, order)
    changed = changes.withColumn("before", F.lag(state).over(own)).withColumn("first", F.row_number().over(own) == 1).filter(F.col("first") | ~F.col(state).eqNullSafe(F.col("before")))
    version = Window.partitionBy(key).orderBy(ts, order)
    return changed.select(key, state, F.row_number().over(version).alias("version"), F.col(ts).alias("valid_from"), F.lead(ts).over(version).alias("valid_until"))


def register(existing: DataFrame, incoming: DataFrame, uri: str, content: str) -> DataFrame:
    """New content versions: what isn't stored under this uri with this checksum, numbered after the stored ones.

    existing: uri, checksum, version. Several new contents of a uri are numbered by checksum.
    """
    new = incoming.select(uri, F.sha2(F.col(content).cast("binary"), 256).alias("checksum")).distinct().join(existing.select(uri, "checksum"), [uri, "checksum"], "left_anti")
    last = existing.groupBy(uri).agg(F.max("version").alias("last"))
    nth = F.row_number().over(Window.partitionBy(uri).orderBy("checksum"))
    return new.join(last, uri, "left").select(uri, "checksum", (F.coalesce("last", F.lit(0)) + nth).alias("version"))


def decayed(rows: DataFrame, now: Column, last_used: str, score: str, uses: str, open_ended: Column, floor: float = 0.1, factor: float = 0.5, warm_days: int = 30, cold_days: int = 120, hot_score: float = 0.8, hot_uses: int = 10) -> DataFrame:
    """tier and next_score: archived at the floor, kept hot, or decayed by the factor down to the floor."""
    idle = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(last_used).cast("timestamp"))) / F.lit(3_600_000_000.0)
    idle = F.greatest(F.lit(0.0), idle)
    archive = ~open_ended | (idle >= cold_days * 24) | (F.col(score) <= floor)
    hot = ~archive & ((F.col(score) >= hot_score) | (F.col(uses) >= hot_uses) | (idle < warm_days * 24))
    tier = F.when(archive, "cold").when(hot, "hot").otherwise("warm")
    following = F.when(archive, F.lit(floor)).when(hot, F.col(score)).otherwise(F.greatest(F.lit(floor), F.col(score) * factor))
    return rows.withColumns({"tier": tier, "next_score": following})


def adjudicated(claims: DataFrame, confidence: str, prior: str, accept: float = 0.6, weak: float = 0.4) -> DataFrame:
    """Effective confidence (own and prior mixed, never below own) and what follows from it."""
    mixed = F.round(0.72 * F.col(confidence) + 0.28 * F.coalesce(F.col(prior), F.col(confidence)), 3)
    effective = F.greatest(F.col(confidence), mixed)
    return claims.withColumn("effective", effective).withColumn("decision", F.when(F.col("effective") >= accept, "accepted").otherwise("rejected")).withColumn(
        "reason", F.when(F.col("effective") >= accept, "confident").when(F.col("effective") >= weak, "below_threshold").otherwise("weak")
    )


def superseded(claims: DataFrame, subject: str, predicate: str, ts: str, order: str, exclusive: list[str]) -> DataFrame:
    """Of each subject and exclusive predicate only the latest claim is open; an earlier one ends at the next."""
    following = F.lead(ts).over(Window.partitionBy(subject, predicate).orderBy(ts, order))
    end = F.when(F.col(predicate).isin(exclusive), following)
    return claims.withColumn("valid_until", end).withColumn("status", F.when(end.isNull(), "active").otherwise("superseded"))


def group_winner(rows: DataFrame, key: list[str], confidence: str, ts: str, order: str, valid_until: str, day: Column) -> DataFrame:
    """The most confident, then latest row of each group with the group's truth: uncertain if open rows name several days."""
    truth = rows.groupBy(*key).agg(F.countDistinct(F.when(F.col(valid_until).isNull(), day)).alias("days"), F.count_if(F.col(valid_until).isNull()).alias("n_open"), F.count(F.lit(1)).alias("n_rows"))
    status = F.when(F.col("days") > 1, "uncertain").when(F.col("n_open") > 0, "active").otherwise("superseded")
    best = top_per_group(rows, key, [F.desc(confidence), F.desc(ts), F.asc(order)])
    return best.join(truth, key).withColumn("truth", status).drop("days", "n_open")


def overlay(rows: DataFrame, actions: DataFrame, key: str, text: str) -> DataFrame:
    """Privacy overlays applied: deleted rows go, redacted ones lose their text, labelled ones carry the label.

    actions: key, action (delete, redact, label), label, applied_at, reverted; the latest unreverted one of a key and action holds.
    """
    latest = top_per_group(actions, [key, "action"], [F.desc("applied_at")]).filter("not reverted")
    gone = latest.filter("action = 'delete'").select(key)
    hidden = latest.filter("action = 'redact'").select(key, F.lit(True).alias("hide"))
    labelled = latest.filter("action = 'label'").select(key, F.col("label").alias("access_label"))
    out = rows.join(gone, key, "left_anti").join(hidden, key, "left").join(labelled, key, "left")
    return out.withColumn(text, F.when(F.col("hide"), "[REDACTED]").otherwise(F.col(text))).drop("hide")


def backoff_minutes(attempts: Column, cap: int = 60) -> Column:
    return F.least(F.lit(float(cap)), F.pow(F.lit(2.0), attempts)).cast("long")


def coverage(rows: DataFrame, group: str, has: Column) -> DataFrame:
    found = rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("covered"))
    return found.withColumn("ratio", F.round(F.col("covered") / F.col("total"), 4))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Both tables with each key once. For a key in both, a column's rule decides: ``greatest``, ``least``, ``sum``,
    ``keep`` (the stored value, unless null) or ``replace`` (the new one, unless null)."""
    both = stored.select(*keys, *[F.col(c).alias(f"stored {c}") for c in rules]).join(new.select(*keys, *[F.col(c).alias(f"new {c}") for c in rules]), keys, "full_outer")

    def merged(column: str, rule: str) -> Column:
        was, now = F.col(f"stored {column}"), F.col(f"new {column}")
        each = {"greatest": lambda: F.greatest(was, now), "least": lambda: F.least(was, now), "sum": lambda: F.coalesce(was + now, was, now), "keep": lambda: F.coalesce(was, now), "replace": lambda: F.coalesce(now, was)}
        return each[rule]().alias(column)

    return both.select(*keys, *[merged(c, r) for c, r in rules.items()])


def replaced_scopes(stored: DataFrame, rebuilt: DataFrame, scope: str, scopes: DataFrame) -> DataFrame:
    """The stored rows with all rows of these scopes (tenants, namespaces) deleted and the rebuilt ones in their place."""
    gone = scopes.select(scope).distinct()
    return stored.join(gone, scope, "left_anti").unionByName(rebuilt.join(gone, scope, "left_semi"))


def rebuild_from_outbox(outbox: DataFrame, facts: DataFrame, stored: DataFrame, scope: str, build) -> DataFrame:
    """``stored`` with the scopes that the outbox names rebuilt by ``build`` from their facts alone."""
    touched = outbox.select(scope).distinct()
    return replaced_scopes(stored, build(facts.join(touched, scope, "left_semi")), scope, touched)
