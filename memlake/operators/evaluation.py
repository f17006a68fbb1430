"""Evaluation and mining: precision and recall, pass rates, percentiles, pattern counts, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.relational import top_per_group


def precision_recall(predicted: DataFrame, expected: DataFrame, case: str, item: str) -> DataFrame:
    """Set precision, recall and F1 of each case, 3 decimals; nothing expected is recall 1, nothing predicted precision 0."""
    both = predicted.select(case, item).distinct().withColumn("p", F.lit(1)).join(expected.select(case, item).distinct().withColumn("e", F.lit(1)), [case, item], "full_outer")
    counts = both.groupBy(case).agg(F.count("p").alias("n_predicted"), F.count("e").alias("n_expected"), F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("hits"))
    precision = F.when(F.col("n_predicted") == 0, 0.0).otherwise(F.col("hits") / F.greatest("n_predicted", F.lit(1)))
    recall = F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("hits") / F.greatest("n_expected", F.lit(1)))
    f1 = F.when(F.col("pr") + F.col("rc") == 0, 0.0).otherwise(2 * F.col("pr") * F.col("rc") / F.greatest(F.col("pr") + F.col("rc"), F.lit(1e-12)))
    return counts.withColumns({"pr": precision, "rc": recall}).select(case, F.round("pr", 3).alias("precision"), F.round("rc", 3).alias("recall"), F.round(f1, 3).alias("f1"))


def pass_rates(rows: DataFrame, category: str, passed: Column, latency: str) -> DataFrame:
    """Pass rate and nearest-rank latency percentiles of each category."""
    nearest = lambda p: F.expr(f"percentile_disc({p}) within group (order by {latency})")
    return rows.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(passed.cast("double")), 4).alias("pass_rate"), nearest(0.5).alias("p50"), nearest(0.95).alias("p95"), F.max(latency).alias("slowest")
    )


def pattern_counts(rows: DataFrame, fields: dict[str, Column], n: int = 8) -> DataFrame:
    """The n most frequent values of each named field, by count, then value."""
    tagged = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()]))
    counts = rows.select(tagged.alias("x")).select("x.field", "x.value").filter("value is not null and value != ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counts, ["field"], [F.desc("n"), F.asc("value")], n, "rank")


def completeness(rows: DataFrame, report: str, section_ok: Column, trail_ok: Column) -> DataFrame:
    """.65 of section coverage and .35 of source-trail coverage, 4 decimals."""
    share = lambda ok: F.count_if(ok) / F.count(F.lit(1))
    return rows.groupBy(report).agg(F.round(0.65 * share(section_ok) + 0.35 * share(trail_ok), 4).alias("completeness"))


def dominant(rows: DataFrame, group: str, subject: str) -> DataFrame:
    """Each group's most frequent subject and its lead over the second."""
    counts = rows.groupBy(group, subject).agg(F.count(F.lit(1)).alias("n"))
    top = top_per_group(counts, [group], [F.desc("n"), F.asc(subject)], 2, "rank")
    return top.groupBy(group).agg(F.max(F.when(F.col("rank") == 1, F.col(subject))).alias("subject"), (F.max("n") - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("n"))), F.lit(0))).alias("margin"))


def isolation(rows: DataFrame, query: str, status: str, score: str) -> DataFrame:
    """Scores shifted by whose row it is; foreign and mixed rows go once a query has an owned one."""
    shift = F.when(F.col(status) == "owned", 2.2).when(F.col(status) == "mixed", -1.5).when(F.col(status) == "foreign", -2.25).otherwise(-0.65)
    owned = rows.groupBy(query).agg(F.bool_or(F.col(status) == "owned").alias("any_owned"))
    out = rows.join(owned, query).filter(~(F.col("any_owned") & F.col(status).isin("foreign", "mixed")))
    return out.withColumn("isolated_score", F.round(F.col(score) + shift, 4)).drop("any_owned")
