"""Structured Streaming forms of the stateful operators: idempotent intake, event-time rollups, late rows, merged tables.

Each takes a streaming DataFrame and leaves source, sink and trigger to the caller; ``drain`` runs one to the end of
what its source has, for batch-like use and tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.session import shared_dir, stored


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def source(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A file source over Parquet with the schema that the files have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # the source watches folders, so a single file is picked from its own
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path)


def idempotent(stream: DataFrame, key: list[str], ts: str, late: str = "7 days") -> DataFrame:
    """Each key once; what comes later than the watermark is dropped, as its key may be forgotten."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def tumbling(stream: DataFrame, ts: str, kind: str, width: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by event-time window and kind; sliding ones with ``slide``."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = stream.withWatermark(ts, late).groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), kind, "n")


def sessions(rows: DataFrame, user: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions by inactivity gap; on a stream, give it a watermark first."""
    found = rows.groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count(F.lit(1)).alias("n_events"))
    return found.select(user, F.col("s.start").alias("session_start"), "n_events")


def split_late(stream: DataFrame, ts: str, late: str, path: str) -> None:
    """Runs a stream into two tables below ``path``: ``on_time``, and ``late`` for rows that are older than the newest row of
    the batches before by more than ``late``. No row is dropped.

    Each batch writes folders of its own, also the newest time that it has seen, so a batch that is run again after a
    failure finds the same mark and overwrites what it wrote: every row is in one of the tables exactly once.
    """
    spark = stream.sparkSession
    marks = "epoch long, high timestamp"

    def write(batch: DataFrame, epoch: int) -> None:
        try:
            known = spark.read.schema(marks).parquet(f"{path}/marks/*").filter(F.col("epoch") < epoch)
            high = known.agg(F.max("high")).first()[0]
        except AnalysisException:  # there is no batch before
            high = None
        moment = F.col(ts).cast("timestamp")
        is_late = F.lit(False) if high is None else F.coalesce(moment < F.lit(high) - F.expr(f"INTERVAL {late}"), F.lit(False))
        batch.persist()
        batch.filter(~is_late).write.mode("overwrite").parquet(f"{path}/on_time/epoch={epoch}")
        batch.filter(is_late).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
        newest = batch.agg(F.max(moment).alias("high")).select(F.lit(epoch).cast("long").alias("epoch"), F.coalesce(F.greatest("high", F.lit(high).cast("timestamp")), "high").alias("high"))
        newest.write.mode("overwrite").parquet(f"{path}/marks/{epoch}")
        batch.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def replayed(results: DataFrame, late: DataFrame, read_again: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``results`` with the groups that late rows belong to built anew by ``build`` from ``read_again``, all rows of an overlap
    that holds these groups. Groups without a late row are not computed again."""
    touched = late.select(*keys).distinct()
    rebuilt = build(read_again.join(touched, keys, "left_semi"))
    return results.join(touched, keys, "left_anti").unionByName(rebuilt)


#: Rows of a feed's file, about.
FEED_ROWS = 1_000_000


def file_feed(df: DataFrame, n: int, order: Column) -> DataFrame:
    """``df`` as a stream of n batches, dealt by ``order`` modulo n: what a feed looks like whose rows come out of order.

    A batch is as many files as its share of the rows fills, so one task writes no more of it where the table is larger. The source
    takes that many files at a time; where a batch has too few rows to fill them, each batch is one file.
    """
    for files in sorted({1, df.count() // n // FEED_ROWS + 1}, reverse=True):
        path = f"{shared_dir(df.sparkSession)}/feed-{uuid.uuid4().hex}"
        for i in range(n):
            batch = df.filter(F.pmod(order, F.lit(n)) == i)
            (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(path)
            if len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles()) != files * (i + 1):
                break
        else:
            break
    return source(df.sparkSession, path, files)


def merge_changes(table: str, changes: DataFrame, key: str, change: str, at: str, buckets: int = 16) -> None:
    """Merges new, changed and deleted keys into a table that is partitioned by ``bucket`` (of the key), rewriting only the buckets
    that have changes. The last change of a key counts; merging the same changes again changes nothing, so a batch
    that is run again after a failure leaves the table as one run does."""
    spark = changes.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.when(F.col(change) == "deleted", 0).otherwise(1).desc()))
    last = stored(changes.withColumn("newest", newest).filter("newest = 1").drop("newest").withColumn("bucket", bucket), "changes")
    kept = last.filter(F.col(change) != "deleted").drop(change)
    try:
        was = spark.read.schema(kept.schema).option("basePath", table).parquet(table)
        touched = last.select("bucket").distinct()
        kept = was.join(touched, "bucket", "left_semi").join(last.select(key), key, "left_anti").unionByName(kept)
    except AnalysisException:  # the first batch
        touched = None
    # written aside first: a table can't be read while it is overwritten
    kept = stored(kept, "merged")
    if touched is not None:  # a bucket whose last key is deleted keeps a row without a key, which readers skip
        emptied = touched.join(kept.select("bucket").distinct(), "bucket", "left_anti").select(*[F.col(c) if c == "bucket" else F.lit(None).cast(kept.schema[c].dataType).alias(c) for c in kept.columns])
        kept = kept.unionByName(emptied)
    kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)


def merged_table(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The rows of a table that ``merge_changes`` keeps."""
    return spark.read.parquet(table).filter(F.col(key).isNotNull()).drop("bucket")


def drain(stream: DataFrame, mode: str = "append", sink: Callable[[DataFrame, str], None] | None = None) -> DataFrame:
    """Runs a stream over all that its source has and reads back what it wrote (complete mode: the last state)."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(df: DataFrame, epoch: int) -> None:
        if sink:
            sink(df, out)
        elif mode == "complete":
            df.write.mode("overwrite").parquet(out)
        else:
            # the folder of an epoch is overwritten when the epoch is run again: exactly once
            df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if sink:  # what it wrote is the sink's to read
        return stream.sparkSession.createDataFrame([], "epoch long") if not _exists(spark, out) else spark.read.parquet(out)
    got = spark.read.parquet(out)
    return got.drop("epoch") if "epoch" in got.columns else got
