"""Operator 5: token counts through a digest cache.

Normalised contents and the tokenizer's version are digested, joined to stored counts, and only distinct contents
without a count are encoded and appended to the cache. Text is shuffled once, to its row's key; of rows that repeat each task sends one;
what meets at a hot digest are rows of 50 bytes, in a join that Spark can split.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows that repeat are each returned; an empty table gives
no rows; other columns of the input are ignored; a null doc_id is returned as null. Texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import common, tokens

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    """Stored counts of this tokenizer version; none where nothing was stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return cache.filter(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])


def count_tokens(docs: DataFrame, cache_dir: str, tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs``; appends new counts to ``cache_dir``."""
    spark = docs.sparkSession
    path, version = tokens.tokenizer_path(tokenizer), tokens.version(tokenizer)
    normal = F.regexp_replace("text", "[ \t\r\n]+", " ") if tokens.splits_at_spaces(path) else F.col("text")
    rows = common.keyed(docs)
    digests = common.stored(
        rows.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(normal.cast("binary"), 256)).alias("digest")),
        "token-digests",
    )
    distinct = digests.groupBy("digest").agg(F.min("row").alias("row"))
    misses = distinct.join(read_cache(spark, cache_dir, version), "digest", "left_anti").hint("shuffle_hash")
    texts = rows.select("row", "text")
    if not common.ids_are_unique(docs):  # rows that repeat have one key, and their text is wanted once
        texts = texts.groupBy("row").agg(F.first("text").alias("text"))
    new = texts.join(misses, "row").select("digest", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            counts = [n for text in batch.column("text") for n in encoder.count([text.as_py()])]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    counted = new.mapInArrow(encode, "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_dir)
    # a table of its own, so that Spark can split the join where a digest has very many rows
    counts = common.stored(read_cache(spark, cache_dir, version), "token-counts")
    return digests.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
