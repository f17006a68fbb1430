"""A stored inverted index: posting blocks with upper bounds of their scores, and searches that skip blocks by them.

Documents are dealt to blocks of at most ``BLOCK`` documents that resemble each other. A row of ``blocks`` is one term in one
block: its postings, and the most that one of them can add to a score. So a term that every document has is many rows
that meet queries by (term, block), and most of them meet none.

A BM25 search first takes a threshold for each query from short lists of its terms' best postings: k documents reach
it, so what stays under it is not among the k best. Terms that cannot reach it even together need not be looked up
by themselves; the blocks of the others whose bounds reach it are read, with all of the query's terms, and nothing else.
Results equal those of ``retrieval.bm25``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memlake.functions.scalar import tokens
from memlake.operators import retrieval
from memlake.operators.relational import top_per_group
from memlake.session import shared_dir, stored

#: Documents of a block, postings that a frequent term keeps by weight.
BLOCK, CHAMPIONS = 128, 64
#: Of the stored tables; an index of another format is another index.
FORMAT = 1
#: Scores are rounded to six digits before they are ranked, so a bound must leave that much.
_ROUNDED = 1e-6


def build(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the index of ``docs`` below ``path``; ``stats`` is written last.

    blocks: term, block, n, bound, postings (key, tf, dl, part). terms: term, df, idf, bound. champions: term, key, part.
    stats: n_docs, avg_dl. ``part`` is BM25's weight without the term's idf. A null text has no terms.
    """
    spark = docs.sparkSession
    # counted where the texts lie: totals need no exchange
    size = docs.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    total = size.first()
    # a row for each document until blocks are made: its terms travel together
    one = retrieval.postings(docs, key, text).groupBy(key).agg(
        F.max_by("term", F.struct("tf", "term")).alias("lead"), F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("terms")
    )
    one = stored(one, "lexical-documents")
    # documents whose most frequent word is the same, then those of similar length, lie side by side; a part holds whole blocks, and
    # what is written is read again, as a place must not change when a task runs again
    ordered = one.repartitionByRange("lead", "dl", key).sortWithinPartitions("lead", "dl", key)
    placed = stored(ordered.select(key, "dl", F.monotonically_increasing_id().alias("place"), "terms"), "lexical-places")
    placed = placed.select(key, "dl", F.floor(F.col("place") / BLOCK).alias("block"), F.explode("terms").alias("t")).select(key, "dl", "block", "t.term", "t.tf")
    length = 1 - retrieval.BM25_B + retrieval.BM25_B * F.col("dl") / F.lit(float(total.avg_dl or 1))
    part = F.col("tf") * (retrieval.BM25_K1 + 1) / (F.col("tf") + retrieval.BM25_K1 * length)
    # a block's documents are in one part, so most of its lists are whole before they are exchanged
    grouped = placed.withColumn("part", part).groupBy("term", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("part").alias("bound"), F.collect_list(F.struct(F.col(key).alias("key"), "tf", "dl", "part")).alias("postings")
    )
    # terms side by side in a file, so that its statistics tell which terms it holds
    grouped.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    idf = F.log(1 + (F.lit(total.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("bound").alias("bound")).withColumn("idf", idf)
    terms.sort("term").write.parquet(f"{path}/terms")
    frequent = spark.read.parquet(f"{path}/terms").filter(F.col("df") > CHAMPIONS).select("term")
    each = blocks.join(frequent, "term", "left_semi").select("term", F.explode("postings").alias("p")).select("term", "p.key", "p.part")
    top_per_group(each, ["term"], [F.desc("part"), F.asc("key")], CHAMPIONS).sort("term").write.parquet(f"{path}/champions")
    spark.createDataFrame([total], size.schema).write.parquet(f"{path}/stats")  # one row


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class LexicalIndex:
    """The index below a path, and its searches. ``key`` is what the documents' key is called in results."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key"):
        self.key = key
        self.blocks, self.terms, self.champions = (spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "champions"))

    @staticmethod
    def of(docs: DataFrame, key: str, text: str = "text", version: str | None = None) -> LexicalIndex:
        """The stored index of exactly these rows, built if there is none yet.

        It is found by ``version``, which must change with the rows (``tables.version`` for a whole table), or else by a digest
        of keys and texts, which reads them. It is built aside and renamed when whole; of two builders the first one's stays.
        """
        spark = docs.sparkSession
        if version is None:
            own = F.xxhash64(key, text).cast("decimal(20,0)")
            seen = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("sum"), F.bit_xor(F.xxhash64(text, key)).alias("mixed")).first()
            version = f"{seen.n}-{seen.sum or 0}-{seen.mixed or 0}"
        path = f"{shared_dir(spark)}/lexical{FORMAT}-{key}-{text}-{version}"
        if not _exists(spark, f"{path}/stats/_SUCCESS"):
            aside = f"{path}-{uuid.uuid4().hex}"
            build(docs, key, text, aside)
            a, b = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (aside, path))
            store = a.getFileSystem(spark._jsc.hadoopConfiguration())
            if store.exists(b) or not store.rename(a, b):
                store.delete(a, True)
        return LexicalIndex(spark, path, key)

    def asked(self, queries: DataFrame, query_key: str, query_text: str) -> DataFrame:
        """query, term, df, idf, most (what the term can add to a score) of the queries' indexed terms."""
        words = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
        known = words.join(self.terms, "term").select("query", "term", "df", "idf", (F.col("idf") * F.col("bound")).alias("most"))
        # a table of known size: small ones are broadcast, and the index is then not shuffled
        return stored(known, "asked")

    def thresholds(self, asked: DataFrame, k: int) -> DataFrame:
        """query, least: a score that at least k documents reach; queries with fewer known documents have none."""
        short = asked.filter(F.col("df") > CHAMPIONS).join(self.champions, "term").select("query", "key", (F.col("idf") * F.col("part")).alias("w"))
        rare = asked.filter(F.col("df") <= CHAMPIONS).join(self.blocks.select("term", "postings"), "term").select("query", "idf", F.explode("postings").alias("p"))
        some = short.union(rare.select("query", "p.key", F.col("idf") * F.col("p.part")))
        partial = some.groupBy("query", "key").agg(F.sum("w").alias("w"))
        best = top_per_group(partial, ["query"], [F.desc("w")], k, "nth")
        return best.filter(F.col("nth") == k).select("query", (F.col("w") - 2 * _ROUNDED).alias("least"))

    def candidates(self, asked: DataFrame, k: int) -> DataFrame:
        """query, block of the blocks that may hold one of a query's k best documents."""
        known = asked.join(self.thresholds(asked, k), "query", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
        upto = F.sum("most").over(Window.partitionBy("query").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0))
        known = known.withColumn("upto", upto)
        # what the terms that can't reach the threshold together may add to a document that has another term
        rest = F.coalesce(F.max(F.when(F.col("upto") < F.col("least"), F.col("upto"))).over(Window.partitionBy("query")), F.lit(0.0))
        needed = known.withColumn("rest", rest).filter(F.col("upto") >= F.col("least")).select("query", "term", "idf", "least", "rest")
        met = needed.join(self.blocks.select("term", "block", "bound").join(asked.select("term"), "term", "left_semi"), "term")
        reach = met.groupBy("query", "block").agg(F.sum(F.col("idf") * F.col("bound")).alias("reach"), F.first("least").alias("least"), F.first("rest").alias("rest"))
        return reach.filter(F.col("reach") + F.col("rest") >= F.col("least")).select("query", "block")

    def bm25(self, queries: DataFrame, query_key: str, query_text: str = "text", k: int = 10) -> DataFrame:
        """The k best documents of each query, with score and rank; k is at most CHAMPIONS for blocks to be skipped."""
        asked = self.asked(queries, query_key, query_text)
        wanted = stored(self.candidates(asked, k), "candidates").join(asked.select("query", "term", "idf"), "query")
        # only blocks of asked terms are exchanged
        blocks = self.blocks.select("term", "block", "postings").join(asked.select("term"), "term", "left_semi")
        met = wanted.join(blocks, ["term", "block"]).select("query", "idf", F.explode("postings").alias("p"))
        scored = met.groupBy("query", F.col("p.key").alias("key")).agg(F.round(F.sum(F.col("idf") * F.col("p.part")), 6).alias("score"))
        best = top_per_group(scored, ["query"], [F.desc("score"), F.asc("key")], k, "rank")
        # a ranking is read more than once, and joined to whole tables: of known size, it is broadcast where it is small
        return stored(best.select(F.col("query").alias(query_key), F.col("key").alias(self.key), "score", "rank"), "ranked")

    def having_all(self, wanted: DataFrame) -> DataFrame:
        """query, alternative, key, tf, dl of the documents with all of an alternative's ``must`` terms and none of its ``nots``.

        An alternative's rarest term says in which blocks and documents to look for the others.
        """
        must = wanted.select("query", "alternative", F.size("must").alias("n"), F.explode("must").alias("term")).join(self.terms.select("term", "df"), "term")
        own = Window.partitionBy("query", "alternative")
        must = must.withColumn("found", F.count(F.lit(1)).over(own)).filter("found = n")  # a term that no document has rules its alternative out
        nth = F.row_number().over(own.orderBy("df", "term"))
        must = stored(must.withColumn("nth", nth).select("query", "alternative", "n", "term", "nth"), "must")
        lead = must.filter("nth = 1").join(self.blocks.select("term", "block", "postings"), "term").select("query", "alternative", "n", "block", "postings")
        pairs = lead.select("query", "alternative", "block", F.transform("postings", lambda p: p.key).alias("keys"))
        among = lambda postings: F.filter(postings, lambda p: F.array_contains(F.col("keys"), p.key))
        blocks = self.blocks.select("term", "block", "postings")
        # only blocks of asked terms are exchanged
        others = must.filter("nth > 1").join(pairs, ["query", "alternative"]).join(blocks.join(must.select("term"), "term", "left_semi"), ["term", "block"])
        rows = lead.select("query", "alternative", "n", F.explode("postings").alias("p")).union(others.select("query", "alternative", "n", F.explode(among(F.col("postings")))))
        met = rows.groupBy("query", "alternative", F.col("p.key").alias("key")).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("found"), F.sum("p.tf").alias("tf"), F.first("p.dl").alias("dl"))
        nots = stored(wanted.select("query", "alternative", F.explode("nots").alias("term")), "nots")
        without = nots.join(pairs, ["query", "alternative"]).join(blocks.join(nots.select("term"), "term", "left_semi"), ["term", "block"]).select("query", "alternative", F.explode(among(F.col("postings"))).alias("p"))
        return met.filter("found = n").join(without.select("query", "alternative", "p.key"), ["query", "alternative", "key"], "left_anti").select("query", "alternative", "key", "tf", "dl")

    def search(self, units: DataFrame, asked: DataFrame, query_key: str, text: str = "text", query_text: str = "text", owner: str | None = None, hints: str | None = None, k: int = 10) -> DataFrame:
        """What ``retrieval.lexical_search`` gives for web-style queries over the indexed units."""
        wanted = retrieval.alternatives(asked, query_key, query_text).withColumnRenamed(query_key, "query")
        # read twice below: by what needs a look at the texts, and by what does not
        met = stored(self.having_all(wanted), "met").withColumnRenamed("key", self.key).withColumnRenamed("query", query_key)
        return retrieval.best_hits(units, asked, met, wanted.withColumnRenamed("query", query_key), self.key, query_key, text, owner, hints, k)
