"""Reading the tables; sinks by partition."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def version(spark: SparkSession, folder: str, name: str) -> str:
    """A digest of a table's files: their names, lengths and times. No data is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    files, seen = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:32]


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; unreadable lines keep their text in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def text_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """path, modified, text and checksum of every file with one of the extensions, below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(extensions)).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("checksum"))


def webhook_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """event_id, at, channel, user, text from JSON payloads of several producers."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(column, p) for p in paths])
    return lines.select(
        get("$.event_id", "$.id").alias("event_id"), get("$.event_time", "$.timestamp", "$.event.ts").alias("at"), get("$.event.channel", "$.channel_id", "$.channel").alias("channel"),
        get("$.event.username", "$.event.user", "$.author.username", "$.user").alias("user"), get("$.event.text", "$.content", "$.text").alias("text"),
    )


def overlap_pull(stored: DataFrame, pulled: DataFrame, key: str, payload: Column) -> DataFrame:
    """key and outcome (created, updated, skipped) of records read again with an overlap; stored: key, hash."""
    new = pulled.select(key, F.sha2(payload.cast("binary"), 256).alias("new_hash"))
    outcome = F.when(F.col("hash").isNull(), "created").when(F.col("hash") != F.col("new_hash"), "updated").otherwise("skipped")
    return new.join(stored.select(key, "hash"), key, "left").select(key, outcome.alias("outcome"))


def write_by_day(df: DataFrame, ts: str, path: str) -> None:
    """A folder for each day: y=/m=/d=."""
    dated = df.withColumns({"y": F.year(ts), "m": F.month(ts), "d": F.dayofmonth(ts)})
    dated.repartition("y", "m", "d").write.mode("overwrite").partitionBy("y", "m", "d").parquet(path)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags dropped, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


def page_parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Pages of a text, split at form feeds, or else at ``--- page N ---`` lines."""
    parts = F.when(F.contains(F.col(text), F.lit("\f")), F.split(F.col(text), "\f")).otherwise(F.split(F.col(text), r"(?m)^--- page \d+ ---$"))
    trimmed = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: F.length(p) > 0)
    return docs.select(key, F.posexplode(trimmed).alias("page", "page_text"))


def reconciled(files: DataFrame, ledger: DataFrame, path: str, checksum: str, readable: Column, extensions: tuple[str, ...]) -> DataFrame:
    """path and outcome of each scanned file: ignored (extension), failed (unreadable), unchanged (path and checksum are in
    the ledger) or ingested."""
    known = ledger.select(path, checksum).distinct().withColumn("known", F.lit(True))
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:\?.*)?$", 1))
    outcome = F.when(~extension.isin(*extensions), "ignored").when(~readable, "failed").when(F.col("known"), "unchanged").otherwise("ingested")
    return files.join(known, [path, checksum], "left").select(path, checksum, outcome.alias("outcome"))


def rewrite_scopes(df: DataFrame, scope: str, path: str) -> None:
    """Deletes and rewrites, in a table that is partitioned by scope, the partitions of the scopes that ``df`` has rows of."""
    df.repartition(scope).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)
