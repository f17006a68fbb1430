"""What the operators share: reading tables, the shared work folder, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LONG = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a folder of this machine; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/memlake-shared"
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(docs: DataFrame, target: int) -> int:
    """Shuffle partitions, more where the texts would else exceed ``target`` bytes in one."""
    total = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-total // target))


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Ints that ``repartition(n, key)`` deals to n different partitions, one each: the smallest that hash there."""
    part = F.pmod(F.hash("key"), F.lit(n))
    some = spark.range(32 * n + 1000).select(F.col("id").cast("int").alias("key")).groupBy(part.alias("part")).agg(F.min("key").alias("key")).collect()
    found = {r.part: r.key for r in some}
    return [found.get(i, i) for i in range(n)]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ids_are_unique(docs: DataFrame) -> bool:
    """Whether every row has a doc_id of its own; reads the one column."""
    repeated = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    return not repeated.limit(1).count()


def row_key(docs: DataFrame) -> Column:
    """A long that names a row: its doc_id where these are unique, or else a 64-bit digest of doc_id and text.

    With repeated ids, rows of one doc_id but other texts stay apart, and equal rows share a key and so a result.
    """
    if ids_are_unique(docs):
        # never null, and said so: else Spark filters nulls below some of the joins and can't share their exchange
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit("/"), text_or_empty())


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty), any more columns, and the row's key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more, row_key(docs).alias("row"))
