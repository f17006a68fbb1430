"""Projections of facts by subject, kept as versions that hold only what changed.

A version is a folder with the rows of the subjects that changed since the version before, and their digests. It counts once
its marker is written, last of all, so readers see a version whole or not at all, and a rebuild that died is written over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import stored


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    names = [f.getPath().getName() for f in store.listStatus(root)]
    found = sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v="))
    return [v for v in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/done/_SUCCESS"))]


def digests(facts: DataFrame, subject: str) -> DataFrame:
    """subject, digest: a value that depends on all rows of a subject and not on their order."""
    columns = sorted(facts.columns)
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    again = F.xxhash64(row, F.lit(1))  # sums of two digests, as one may meet its like
    own = F.concat_ws("-", F.count(F.lit(1)), F.sum(row.cast("decimal(20,0)")), F.sum(again.cast("decimal(20,0)")))
    return facts.groupBy(subject).agg(own.alias("digest"))


def _latest(spark: SparkSession, path: str, subject: str, upto: list[int]) -> DataFrame:
    """subject, digest, version: of each subject its last version (a digest of null: it has gone)."""
    every = None
    for v in upto:
        one = spark.read.parquet(f"{path}/v={v}/digests").withColumn("version", F.lit(v))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(subject).agg(F.max_by("digest", "version").alias("digest"), F.max("version").alias("version"))


def rebuild(facts: DataFrame, subject: str, build: Callable[[DataFrame], DataFrame], path: str) -> tuple[int, int]:
    """Brings the projection below ``path`` to these facts; returns its version and the number of subjects built anew.

    ``build`` gives rows by subject from the facts of the subjects it is given. Subjects without facts are no more.
    """
    spark = facts.sparkSession
    known = _versions(spark, path)
    now = digests(facts, subject)
    if known:
        was = _latest(spark, path, subject, known).filter("digest is not null").select(subject, F.col("digest").alias("was"))
        now = now.join(was, subject, "full_outer").filter(~F.col("digest").eqNullSafe(F.col("was"))).select(subject, "digest")
    changed = stored(now, "projection-changes")
    version = (known[-1] if known else 0) + 1
    base = f"{path}/v={version}"
    touched = changed.filter("digest is not null").select(subject)
    build(facts.join(touched, subject, "left_semi")).write.mode("overwrite").parquet(f"{base}/rows")
    changed.write.mode("overwrite").parquet(f"{base}/digests")
    changed.limit(0).write.mode("overwrite").parquet(f"{base}/done")
    return version, changed.count()


def current(spark: SparkSession, path: str, subject: str, version: int | None = None) -> DataFrame:
    """The projection's rows as of a version (the last one), with the version that each subject was built in."""
    upto = [v for v in _versions(spark, path) if version is None or v <= version]
    latest = _latest(spark, path, subject, upto).filter("digest is not null").select(subject, "version")
    every = None
    for v in upto:
        one = spark.read.parquet(f"{path}/v={v}/rows").withColumn("version", F.lit(v))
        every = one if every is None else every.unionByName(one)
    return every.join(latest, [subject, "version"])


def report_heads(facts: DataFrame, subject: str, kind: str, at: str, key: str, required: tuple[str, ...]) -> DataFrame:
    """A head for each subject: its facts, the latest one, the fields (kinds) that are there of those required, and how complete that is."""
    have = F.array_sort(F.array_intersect(F.collect_set(kind), F.array(*map(F.lit, required))))
    heads = facts.groupBy(subject).agg(F.count(F.lit(1)).alias("support"), F.max_by(key, F.struct(at, key)).alias("latest"), have.alias("fulfilled"))
    score = F.round(F.size("fulfilled") / F.lit(len(required)), 4)
    status = F.when(score >= 1, "complete").when(score > 0, "partial").otherwise("missing")
    return heads.withColumns({"completeness": score, "truth": status, "fulfilled": F.array_join("fulfilled", ",")})
