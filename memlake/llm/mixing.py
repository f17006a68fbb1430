"""Operator 4: mixing sources to target weights by Sainte-Lague apportionment, with DataFrame operations alone.

Sources share a fixed multiple of all words by weight, none more than ``max_repeats`` times its own size; what a source
can't take is shared among the others. Each source is dealt into shards of about ``shard_words`` words by a seeded hash,
and a shard's documents, in seeded order, form an axis that is cut into equal blocks. Blocks are then apportioned to
shards by the highest quotients target / (2 k + 1), and a shard takes whole passes over its blocks and, for the rest of
its quota, the blocks that follow a seeded start. So a quota is an integer, a hot source is many shards, and the only
global steps are on sources and shards, whose running sums and ranks are range-partitioned (``running``).

Defined cases: a null text has no words; a null source is a source of its own, after all others; a document without
words takes none; rows that repeat are separate documents, in the order of their hash; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm import common

#: Weights of the sources in code point order, repeated.
WEIGHTS = (3, 1, 2)
#: Copies of a repeated row that one row of a join stands for at most.
ROWS = 64
WORD = r"[^\x20\x09-\x0D]+"
SEED = 17


def _row(docs: DataFrame) -> Column:
    """A row's key: its doc_id where ids are unique, or else a digest of what the mix reads of it."""
    if common.ids_are_unique(docs):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    return F.xxhash64(F.col("doc_id").cast("long"), F.lit("/"), F.col("source").cast("string"), F.lit("/"), common.text_or_empty())


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """``df`` with, for each name, the sum of its column over the rows before and up to this one in a total order.

    Two levels: rows are range-partitioned by the order and summed inside each part; what a part's sums start from
    comes from the totals of the parts before it, one row for each part.
    """
    spark = df.sparkSession
    placed = df.select("*", *[c.alias(f"{name} own") for name, c in sums.items()]).repartitionByRange(common.partitions(spark), *order)
    placed = common.stored(placed.withColumn("part", F.spark_partition_id()), "running")
    totals = placed.groupBy("part").agg(*[F.sum(f"{name} own").alias(f"{name} total") for name in sums])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as parts
    starts = totals.select("part", *[F.coalesce(F.sum(f"{name} total").over(before), F.lit(0)).alias(f"{name} start") for name in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.select("*", *[F.sum(f"{name} own").over(inside).alias(name) for name in sums]).join(F.broadcast(starts), "part")
    return out.select(*df.columns, *[(F.col(name) + F.col(f"{name} start")).alias(name) for name in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: float) -> DataFrame:
    """source_key, source_size and target: by weight, level with the largest multiple of weights that no cap exceeds.

    The level solves sum(min(cap, level * weight)) = share * total; it lies between two neighbouring ratios of cap to
    weight, and everything below it is capped.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int")).cast("double")
    # code point order is byte order of UTF-8, which is how Spark compares strings; a null source's key comes last
    known = running(sizes, [F.col("source_key")], nth=F.lit(1)).withColumn("weight", weight)
    known = known.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("ratio", F.col("cap") / F.col("weight"))
    known = common.stored(running(known, [F.col("ratio"), F.col("nth")], cap_here=F.col("cap"), weight_here=F.col("weight")), "mixing-sources")
    total = known.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    wanted, all_weights = float(total.words or 0) * float(share), float(total.weight or 0)
    level = F.greatest(F.lit(0.0), F.lit(wanted) - (F.col("cap_here") - F.col("cap"))) / (F.lit(all_weights) - (F.col("weight_here") - F.col("weight")))
    # the first source, by ratio, that its level doesn't cap sets the level of all
    found = known.agg(F.min_by(level, F.when(level <= F.col("ratio"), F.struct("ratio", "nth"))).alias("level")).first().level
    target = F.col("cap") if found is None else F.least(F.col("cap"), F.lit(found) * F.col("weight"))
    return known.select("source_key", "source_size", target.alias("target"))


def apportion(shards: DataFrame) -> DataFrame:
    """Adds ``quota`` to shards(source_key, shard, votes, most): seats (the sum of votes) by highest quotients
    votes / (2 k + 1), at most ``most``.

    Instead of ranking every quotient, the divisors between which the right one must lie bound each quota; only the
    quotients between (about two a shard) are ranked.
    """
    # as decimals, whose sum does not depend on the order
    total = shards.agg(F.sum(F.col("votes").cast("decimal(28,6)")).alias("votes"), F.count(F.lit(1)).alias("n")).first()
    votes, n = float(total.votes or 0), total.n
    seats, divisor = round(votes), max(votes, 1e-9)
    bound = (
        shards.withColumn("sure", F.greatest(F.lit(0.0), F.floor(F.col("votes") * F.lit(max(0.0, seats - n) / divisor) - 0.5)))
        .withColumn("sure", F.least(F.col("sure"), F.col("most")).cast("long"))
        .withColumn("last", F.least(F.ceil(F.col("votes") * F.lit((seats + n) / divisor) + 0.5), F.col("most")).cast("long"))
    )
    bound = common.stored(bound, "mixing-bounds")
    open_seats = seats - (bound.agg(F.sum("sure")).first()[0] or 0)
    quotients = bound.filter("last > sure").withColumn("k", F.explode(F.sequence(F.col("sure"), F.col("last") - 1)))
    quotients = quotients.select("source_key", "shard", "k", (F.col("votes") / (2 * F.col("k") + 1)).alias("quotient"))
    ranked = running(quotients, [F.col("quotient").desc(), F.col("source_key"), F.col("shard"), F.col("k")], nth=F.lit(1))
    won = ranked.filter(F.col("nth") <= open_seats).groupBy("source_key", "shard").agg(F.count(F.lit(1)).alias("more"))
    return bound.join(won, ["source_key", "shard"], "left").withColumn("quota", F.col("sure") + F.coalesce("more", F.lit(0))).drop("sure", "last", "more")


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    max_repeats: int = 2,
    block_words: int = 16,
    shard_words: int = 1 << 17,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, row, size, source_size, target, taken; and of the last, partial pass the word spans that it takes.

    ``passes`` counts whole passes over the document; ``from1, to1, from2, to2`` bound the words of the partial one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row(docs).alias("row"), F.col("source").cast("string").alias("source"), F.regexp_count(common.text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
    # a null source is told from every other by its key
    rows = common.stored(rows.withColumn("source_key", F.concat_ws(":", F.col("source").isNull().cast("int"), "source")), "sizes")
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    per_source = targets(sizes, weights, share, max_repeats).withColumn("n_shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words))
    dealt = rows.join(F.broadcast(per_source) if per_source.limit(10_001).count() <= 10_000 else per_source, "source_key").withColumn("order", F.xxhash64("row", F.lit(seed)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("order"), "n_shards"))
    # the axis of a shard: its documents in seeded order
    along = Window.partitionBy("source_key", "shard").orderBy("order", "doc_id")
    placed = dealt.withColumn("end", F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    shards = (
        dealt.groupBy("source_key", "shard")
        .agg(F.sum("size").alias("shard_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
        .filter("shard_size > 0")
        .withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words)).cast("long"))
        # votes are in blocks of this shard's own width, so that quota * width meets the target
        .withColumn("votes", F.col("target") * F.col("shard_size") / F.col("source_size") * F.col("blocks") / F.col("shard_size"))
        .withColumn("most", (F.col("blocks") * max_repeats).cast("double"))
    )
    quotas = apportion(shards).withColumn("start_block", F.pmod(F.xxhash64("source_key", "shard", F.lit(seed)), "blocks"))
    quotas = quotas.withColumn("passes", F.floor(F.col("quota") / F.col("blocks"))).withColumn("rest", F.col("quota") % F.col("blocks"))
    edge = lambda block: F.floor(block * F.col("shard_size") / F.col("blocks"))
    stop = F.col("start_block") + F.col("rest")
    quotas = quotas.select(
        "source_key", "shard", "passes", edge(F.col("start_block")).alias("c1"), edge(F.least(stop, "blocks")).alias("d1"), edge(F.greatest(stop - F.col("blocks"), F.lit(0))).alias("d2")
    )
    spans = [F.greatest(F.col("c1") - F.col("start"), F.lit(0)), F.least(F.col("d1") - F.col("start"), "size"), F.lit(0), F.least(F.col("d2") - F.col("start"), "size")]
    out = placed.join(quotas, ["source_key", "shard"], "left").select(
        "doc_id", "row", "size", "source_size", "target", F.coalesce("passes", F.lit(0)).alias("passes"),
        *[F.coalesce(x, F.lit(0)).cast("long").alias(name) for x, name in zip(spans, ("from1", "to1", "from2", "to2"), strict=True)],
    )
    partial = F.greatest(F.col("to1") - F.col("from1"), F.lit(0)) + F.greatest(F.col("to2") - F.col("from2"), F.lit(0))
    return out.withColumn("taken", (F.col("passes") * F.col("size") + partial).cast("long"))


def take(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with their columns as the mix takes them: a row for each whole pass over a document, and one with the
    words of its partial pass (blanks after a word stay with it); n_chars follows the text.

    Rows that agree in doc_id, source and text are one text that is taken by all their amounts.
    """
    amount = ["row", "passes", "from1", "to1", "from2", "to2"]
    amounts = mix(docs, **options).filter("taken > 0")
    keyed = docs.select(F.struct("*").alias("d"), _row(docs).alias("row"))
    if common.ids_are_unique(docs):
        amounts = amounts.select(*amount, F.lit(1).alias("rows"))
    else:
        keyed = keyed.dropDuplicates(["row"])
        some = amounts.groupBy(*amount).agg(F.count(F.lit(1)).alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / ROWS))))
        # a table of its own, so that Spark can split the join where a row is repeated very often
        amounts = common.stored(some.select(*amount, F.least(F.lit(ROWS), F.col("n") - F.col("nth") * ROWS).cast("int").alias("rows")), "mixing-amounts")
    words = F.regexp_extract_all("d.text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    inside = lambda _, i: ((i >= F.col("from1")) & (i < F.col("to1"))) | ((i >= F.col("from2")) & (i < F.col("to2")))
    some = (F.col("to1") > F.col("from1")) | (F.col("to2") > F.col("from2"))
    part = F.when(some, F.array(F.array_join(F.filter(words, inside), ""))).otherwise(F.array().cast("array<string>"))
    texts = F.flatten(F.array_repeat(F.concat(F.array_repeat(F.col("d.text"), F.col("passes").cast("int")), part), F.col("rows")))
    # few columns a document, beside its text
    joined = keyed.join(amounts.hint("shuffle_hash"), "row").select("d", F.explode(texts).alias("taken text"))
    out = {"text": F.col("taken text")} | ({"n_chars": F.length("taken text").cast("long")} if "n_chars" in docs.columns else {})
    return joined.select("d.*", "taken text").select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
