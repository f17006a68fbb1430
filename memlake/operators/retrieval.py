"""Lexical, vector and fused retrieval over many queries at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scalar import dot, overlap_share, tokens
from memlake.operators.relational import PAIRS, top_per_group
from memlake.session import stored

# Rank constant, trade-off and pool of the fused ranking; BM25's usual constants.
RRF_K = 60
MMR_LAMBDA = 0.68
BM25_K1, BM25_B = 1.2, 0.75
# Words that a question's overlap with a candidate does not count.
POOL_STOP_WORDS = (
    "what", "which", "does", "did", "when", "year", "month", "date", "why", "who", "is", "are", "the", "his", "her", "their", "its", "start", "started",
)
# Fixed values end.
# Queries and rows that meet in one task, and queries scored at a time.
QUERY_BLOCK, ROW_BLOCK, SCORED = 4096, 8192, 256


def listed_terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, terms, dl. Texts are dealt by key before they are cut, as postings take more room than the texts they come
    from; what counts terms of a document then needs no further exchange, and several readers share this one."""
    dealt = docs.select(key, F.col(text).alias("text")).repartition(F.col(key))
    return dealt.select(key, tokens(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf and dl (length of the document in tokens)."""
    terms = listed_terms(docs, key, text).select(key, "dl", F.explode("terms").alias("term"))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, key: str, query_key: str, text: str = "text", query_text: str = "text", k: int = 10) -> DataFrame:
    """The k best documents of each query, with score and rank, in two passes over the texts and without an index.

    Texts are dealt once, to be cut; of their postings only those of asked terms stay, a list for each document. Documents are then
    dealt with these lists to tasks of about ``PAIRS`` documents times queries, which make, sum and rank the scores: no posting
    and no score is shuffled, but each task's k best of a query.
    """
    spark = docs.sparkSession
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    # tables of known size: small ones are broadcast, and postings then stay where they are
    known = stored(asked.select("term").distinct(), "asked-terms")
    size = docs.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    total, n_asked = size.first(), queries.count()
    terms = listed_terms(docs, key, text).select(key, "dl", F.explode("terms").alias("term")).join(known, "term", "left_semi")
    counted = terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    lists = stored(counted.groupBy(key).agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("terms")), "asked-postings")
    df = lists.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(total.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = stored(asked.join(df, "term").select(query_key, "term", idf.alias("idf")), "asked-weights")
    tasks = max(spark.sparkContext.defaultParallelism, total.n_docs * n_asked // PAIRS + 1)
    length = 1 - BM25_B + BM25_B * F.col("dl") / F.lit(float(total.avg_dl or 1))
    posted = lists.repartition(tasks, key).select(key, "dl", F.explode("terms").alias("t")).select(key, "t.term", (F.col("t.tf") * (BM25_K1 + 1) / (F.col("t.tf") + BM25_K1 * length)).alias("part"))
    scored = posted.join(weights, "term").groupBy(query_key, key).agg(F.round(F.sum(F.col("idf") * F.col("part")), 6).alias("score"))
    # a ranking is read more than once, and joined to whole tables: of known size, it is broadcast where it is small
    return stored(top_per_group(scored, [query_key], [F.desc("score"), F.asc(key)], k, "rank"), "ranked")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, vector: str = "embedding", k: int = 10) -> DataFrame:
    """Exact cosine neighbours of every query among all rows, however many there are of either.

    Queries and rows are dealt to numbered blocks by a digest, every block of queries meets every block of rows in a
    group of its own, and the k best of each query and block are merged.
    """
    asked = queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v"))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n_asked, n_rows = (max(1, -(-df.count() // size)) for df, size in ((asked, QUERY_BLOCK), (rows, ROW_BLOCK)))
    block = lambda name, n: F.pmod(F.xxhash64(name, "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("q", "v", block("q", n_asked).alias("qb"), every(n_rows).alias("rb"))
    rows = rows.select("id", "v", block("id", n_rows).alias("rb"), every(n_asked).alias("qb"))

    def unit(column):
        own = np.stack(column.to_numpy()).astype(float)
        return own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-300)

    def score(theirs, ours):
        out = [pd.DataFrame({"q": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(theirs) and len(ours):
            matrix, own, ids, asking = unit(theirs["v"]), unit(ours["v"]), ours["id"].to_numpy(), theirs["q"].to_numpy()
            for at in range(0, len(asking), SCORED):
                # rounded before ranking, so that ties are ties in whatever order sums were taken
                sims = np.round(matrix[at : at + SCORED] @ own.T, 6)
                for q, line in zip(asking[at : at + SCORED], sims, strict=True):
                    other = np.flatnonzero(ids != q)
                    if len(other) > k:
                        other = other[line[other] >= np.partition(line[other], -k)[-k]]
                    best = other[np.lexsort((ids[other], -line[other]))[:k]]
                    out.append(pd.DataFrame({"q": q, "id": ids[best], "score": line[best]}))
        return pd.concat(out, ignore_index=True)

    found = asked.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(score, "q long, id long, score double")
    best = top_per_group(found, ["q"], [F.desc("score"), F.asc("id")], k, "rank")
    return best.select(F.col("q").alias(query_key), F.col("id").alias(key), "score", "rank")


def centroid_similarity(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Each group's size and mean squared norm, by posexplode-free array aggregation."""
    return vectors.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(dot(F.col(vector), F.col(vector))), 5).alias("mean_square"))


def reciprocal_rank_fusion(rankings: list[DataFrame], query_key: str, key: str, k: int = 10, rank: str = "rank") -> DataFrame:
    """Sum of 1 / (60 + rank) over rankings; the k best of each query."""
    parts = [r.select(query_key, key, (1 / (RRF_K + F.col(rank))).alias("part")) for r in rankings]
    fused = reduce(DataFrame.unionByName, parts).groupBy(query_key, key).agg(F.round(F.sum("part"), 9).alias("rrf_score"))
    return top_per_group(fused, [query_key], [F.desc("rrf_score"), F.asc(key)], k, "rank")


def hybrid_score(topic_hits: Column, is_seed: Column, lexical_rank: Column, vector_rank: Column, epoch_ms: Column) -> Column:
    """Topic matches twice, a seed once, 1 / (rank + 1) of the lexical and 1.25 times that of the vector ranking (ranks
    from 0, null: not ranked), and recency as the last digits."""
    reciprocal = lambda rank, weight: F.coalesce(F.lit(weight) / (rank + 1), F.lit(0.0))
    return topic_hits * 2.0 + is_seed.cast("double") + reciprocal(lexical_rank, 1.0) + reciprocal(vector_rank, 1.25) + epoch_ms / F.lit(1e15)


def mmr(candidates: DataFrame, query_key: str, key: str, relevance: str, terms: str, limit: int = 10, pool: int = 24, trade_off: float = MMR_LAMBDA) -> DataFrame:
    """Greedy maximal marginal relevance of each query's pool, by Jaccard on tokens; a pool is bounded by ``pool``."""

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["relevance", "id"], ascending=[False, True], ignore_index=True)
        sets = [set(t) for t in pdf["terms"]]
        gain, near = pdf["relevance"].to_numpy(float), np.zeros(len(pdf))
        order: list[int] = []
        left = list(range(len(pdf)))
        while left and len(order) < limit:
            at = left[0] if not order else max(left, key=lambda i: (trade_off * gain[i] - (1 - trade_off) * near[i], -i))
            order.append(at)
            left.remove(at)
            for i in left:
                both, either = len(sets[i] & sets[at]), len(sets[i] | sets[at])
                near[i] = max(near[i], both / either if sets[i] and sets[at] else 0.0)
        return pd.DataFrame({"q": pdf["q"].iloc[0], "id": pdf["id"].iloc[order].to_numpy(), "rank": np.arange(1, len(order) + 1)})

    top = top_per_group(candidates, [query_key], [F.desc(relevance), F.asc(key)], pool)
    ready = top.select(F.col(query_key).alias("q"), F.col(key).alias("id"), F.col(relevance).cast("double").alias("relevance"), F.col(terms).alias("terms"))
    return ready.groupBy("q").applyInPandas(rerank, "q long, id long, rank int").select(F.col("q").alias(query_key), F.col("id").alias(key), "rank")


def neighbours(units: DataFrame, seeds: DataFrame, group: str, position: str) -> DataFrame:
    """Units that share a group with a seed, with the distance to the nearest seed."""
    at = seeds.select(group, F.col(position).alias("seed_position"))
    return units.join(at, group).groupBy(*units.columns).agg(F.min(F.abs(F.col(position) - F.col("seed_position"))).alias("distance"))


def latest_per_topic(rows: DataFrame, group: str, topics: list[str], text: str, order: list[Column]) -> DataFrame:
    """The first row, in order, of each group and topic word that the text contains."""
    matched = rows.withColumn("topic", F.explode(F.filter(F.array(*map(F.lit, topics)), lambda t: F.contains(F.lower(F.col(text)), t))))
    return top_per_group(matched, [group, "topic"], order)


def evidence(rows: DataFrame, keys: list[str], text: str, order: list[Column], width: int = 320, limit: int = 12) -> DataFrame:
    """Rows of distinct key, with a snippet, capped."""
    one = top_per_group(rows, keys, order).withColumn("snippet", F.substring(F.col(text), 1, width))
    return one.orderBy(*order).limit(limit)


def ranked_window(df: DataFrame, query_key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(*order)))


def alternatives(asked: DataFrame, query_key: str, query_text: str) -> DataFrame:
    """query, alternative, must (terms), phrases and nots of web-style queries: ``"a phrase" word or other -without``."""
    alternative = asked.select(query_key, F.posexplode(F.split(F.lower(query_text), r"\s+or\s+")).alias("alternative", "said"))
    plain = F.regexp_replace("said", r'"[^"]*"', " ")
    phrases = F.transform(F.regexp_extract_all("said", F.lit(r'"([^"]+)"'), F.lit(1)), lambda p: tokens(p))
    own = alternative.withColumns({
        "phrases": phrases,
        "nots": F.regexp_extract_all(plain, F.lit(r"(?:^|\s)-([a-z0-9]+)"), F.lit(1)),
        "must": F.array_distinct(F.concat(tokens(F.regexp_replace(plain, r"(^|\s)-[a-z0-9]+", " ")), F.flatten(phrases))),
    })
    return own.select(query_key, "alternative", "must", "phrases", "nots").filter(F.size("must") > 0)


def lexical_search(units: DataFrame, asked: DataFrame, key: str, query_key: str, text: str = "text", query_text: str = "text", owner: str | None = None, hints: str | None = None, k: int = 10) -> DataFrame:
    """The k best units of each web-style query: those with all terms and phrases of one of its alternatives and none
    of its excluded terms, and (``owner``) those owned by one of the query's ``hints``; score is the share of matched
    tokens in the unit, the best alternative's.

    Terms meet postings in an equi-join; texts are read again only for what has all terms of an alternative with a phrase.
    """
    wanted = alternatives(asked, query_key, query_text)
    terms = wanted.select(F.explode("must").alias("term")).union(wanted.select(F.explode("nots"))).distinct()
    posted = postings(units, key, text).join(terms, "term", "left_semi")
    needed = wanted.select(query_key, "alternative", F.size("must").alias("n"), F.explode("must").alias("term"))
    met = needed.join(posted, "term").groupBy(query_key, "alternative", key).agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("found"), F.sum("tf").alias("tf"), F.first("dl").alias("dl")).filter("found = n")
    without = wanted.select(query_key, "alternative", F.explode("nots").alias("term")).join(posted, "term").select(query_key, "alternative", key).distinct()
    met = met.join(without, [query_key, "alternative", key], "left_anti")
    return best_hits(units, asked, met, wanted, key, query_key, text, owner, hints, k)


def best_hits(units: DataFrame, asked: DataFrame, met: DataFrame, wanted: DataFrame, key: str, query_key: str, text: str, owner: str | None, hints: str | None, k: int) -> DataFrame:
    """The k best of ``met`` (query, alternative, key, tf, dl: units with all terms of an alternative) that have its phrases, and of
    the units owned by a query's hints."""
    phrased = wanted.filter(F.size("phrases") > 0).select(query_key, "alternative", "phrases")
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    read_again = met.join(phrased, [query_key, "alternative"]).join(units.select(key, F.col(text).alias("unit text")), key)
    read_again = read_again.withColumn("whole", spaced(tokens(F.col("unit text")))).filter(F.forall("phrases", lambda p: F.contains(F.col("whole"), spaced(p))))
    hits = met.join(phrased, [query_key, "alternative"], "left_anti").select(query_key, key, "tf", "dl").union(read_again.select(query_key, key, "tf", "dl"))
    scored = hits.select(query_key, key, F.round(F.col("tf") / F.col("dl"), 9).alias("score"))
    if owner:
        hinted = asked.select(query_key, F.explode(hints).alias("hint")).select(query_key, F.lower("hint").alias("hint")).distinct()
        # of units that a hint alone finds, which score nothing, only an owner's first k can be among a query's k best
        firsts = top_per_group(units.select(key, F.lower(owner).alias("hint")).distinct(), ["hint"], [F.asc(key)], k)
        owned = hinted.join(firsts, "hint").select(query_key, key, F.lit(0.0).alias("score"))
        scored = scored.unionByName(owned)
    best = scored.groupBy(query_key, key).agg(F.max("score").alias("score"))
    return top_per_group(best, [query_key], [F.desc("score"), F.asc(key)], k, "rank")


def with_fallback(primary: DataFrame, fallback: DataFrame, query_key: str) -> DataFrame:
    """The primary provider's rows, and the fallback's for queries that the primary finds nothing for."""
    missed = fallback.join(primary.select(query_key).distinct(), query_key, "left_anti")
    return primary.withColumn("provider", F.lit("primary")).unionByName(missed.withColumn("provider", F.lit("fallback")))


def question_overlap(question: Column, candidate: Column) -> Column:
    """Share of a question's distinct words, stop words left out, that the candidate has."""
    words = lambda c: F.filter(tokens(c, "[a-z0-9+]+"), lambda t: F.length(t) > 1)
    return overlap_share(F.array_except(words(question), F.array(*map(F.lit, POOL_STOP_WORDS))), words(candidate))


def pool_fusion(pool: DataFrame, query_key: str, key: str, structured: str, lexical: str, priority: str, position: str) -> DataFrame:
    """A pool with fused score, relevance and place: candidates ranked by structure, by lexical overlap and by source
    priority (ties in the order they came), fused by reciprocal ranks; relevance adds structure and overlap."""
    by = lambda c: F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(c), F.asc(position)))
    ranked = pool.withColumns({f"{c} rank": by(c) for c in (structured, lexical, priority)})
    fused = F.round(sum((1 / (RRF_K + F.col(f"{c} rank")) for c in (structured, lexical, priority)), F.lit(0.0)), 9)
    out = ranked.withColumn("fused", fused).withColumn("relevance", F.round(F.col("fused") + F.col(structured) + F.col(lexical), 9)).drop(*[f"{c} rank" for c in (structured, lexical, priority)])
    return ranked_window(out, query_key, [F.desc("fused"), F.desc(structured), F.asc(position)]).withColumnRenamed("rank", "place")


def summary_read(nodes: DataFrame, edges: DataFrame, windows: DataFrame, asked: DataFrame, query_key: str, limit: int = 5) -> DataFrame:
    """Summary nodes for each query's ``terms``, most terms contained first, then upper ones, and the source windows below.

    nodes: node_id, depth, summary. edges: parent_id, child_id. windows: node_id (a leaf's), window_id. Terms meet
    summaries by their words; a node of the graph's top is read through its children.
    """
    words = nodes.select("node_id", "depth", F.explode(F.array_distinct(tokens(F.col("summary")))).alias("term"))
    counted = asked.select(query_key, F.explode(F.array_distinct("terms")).alias("term")).join(words, "term").groupBy(query_key, "node_id", "depth").agg(F.count(F.lit(1)).alias("match_count"))
    best = top_per_group(counted, [query_key], [F.desc("match_count"), F.asc("depth"), F.asc("node_id")], limit, "rank")
    leaves = best.select("node_id").distinct().join(edges, F.col("node_id") == F.col("parent_id")).select("node_id", F.col("child_id").alias("leaf"))
    leaves = leaves.union(best.select("node_id", F.col("node_id").alias("leaf")).distinct())
    below = leaves.join(windows.select(F.col("node_id").alias("leaf"), "window_id"), "leaf").groupBy("node_id").agg(F.count(F.lit(1)).alias("n_windows"), F.min("window_id").alias("first_window"))
    return best.join(below, "node_id", "left").select(query_key, "node_id", "depth", "match_count", "rank", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), "first_window")
