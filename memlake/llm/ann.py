"""Operator 7: approximate nearest neighbours by cosine, over balanced posting lists.

Centroids are the means of a balanced tree over a bounded sample (each split halves it). A graph that links each
centroid with its nearest ones is searched best-first to find the lists near a vector. Boundary vectors are replicated
to several lists: those whose centroid is at most ``replica_ratio`` times as far as the nearest, unless a chosen centroid
lies nearer to it. A query reads the lists whose centroid is within ``probe_ratio`` of the nearest distance. Lists are
dealt in parts of bounded size, and a part compares its vectors with its queries in blocks.

Equal vectors are one entry of the index that carries its smallest ids, and equal query vectors are searched once, so a
vector that a third of the table holds is no hot list. Scores are computed exactly, in double precision, on the
original vectors of whatever the lists offer.

Defined cases: null or zero vectors, vectors with null or non-finite components, a null vec_id, and vectors of another
length than most have (the shorter of two as frequent) take no part; repeated rows are one; with fewer than k other
vectors a query returns them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm import common

#: Vectors that the centroids are fitted on, at least and for each list; the index holds every vector.
SAMPLE, LIST_SAMPLE = 16_384, 16
#: Vectors a list should have, most lists (the graph is in every worker's memory), vectors of a part of a list.
LIST_VECTORS, MAX_LISTS, PART_VECTORS = 256, 16_384, 4096
NEIGHBOURS = 24


def balanced_centroids(sample: np.ndarray, n_lists: int, seed: int = 7) -> np.ndarray:
    """Unit means of a tree that halves the sample at each split, along the line between two means."""
    rng = np.random.default_rng(seed)
    groups = [sample]
    while len(groups) < n_lists:
        halves = []
        for g in groups:
            if len(g) < 2:
                halves.append(g)
                continue
            a, b = g[rng.choice(len(g), 2, replace=False)]
            for _ in range(6):
                side = g @ (a - b)
                order = np.argsort(side, kind="stable")
                low, high = g[order[: len(g) // 2]], g[order[len(g) // 2 :]]
                a, b = high.mean(axis=0), low.mean(axis=0)
            halves += [low, high]
        if len(halves) == len(groups):
            break
        groups = halves
    means = np.stack([g.mean(axis=0) for g in groups])
    norms = np.linalg.norm(means, axis=1, keepdims=True)
    return means / np.where(norms > 0, norms, 1)


class CentroidGraph:
    """Each centroid linked to its nearest ones; searched best-first for many vectors at once."""

    def __init__(self, centroids: np.ndarray, degree: int = NEIGHBOURS):
        self.centroids = centroids
        n = len(centroids)
        near = np.argsort(-(centroids @ centroids.T), axis=1, kind="stable")[:, 1 : degree + 1]
        # a few far links, by rule, keep the graph connected
        far = (np.arange(n)[:, None] + np.array([1, n // 7 + 1, n // 3 + 1])) % n
        self.links = np.concatenate([near, far], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of the ``beam`` best found for each unit vector, nearest first."""
        n, k = len(vectors), len(self.centroids)
        beam = min(beam, k)
        expanded = np.zeros((n, k), bool)
        score = np.full((n, k), -np.inf)
        score[:, self.entries] = vectors @ self.centroids[self.entries].T
        active = np.arange(n)
        while len(active):
            open_score = np.where(expanded[active], -np.inf, score[active])
            best = open_score.argmax(axis=1)
            value = open_score[np.arange(len(active)), best]
            # a vector is done when its best open centroid is worse than the beam's last
            last = np.partition(score[active], k - beam, axis=1)[:, k - beam]
            going = np.isfinite(value) & (value >= last)
            active, best = active[going], best[going]
            expanded[active, best] = True
            next_ones = self.links[best]
            dots = np.einsum("nd,nld->nl", vectors[active], self.centroids[next_ones])
            score[active[:, None], next_ones] = dots
        order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        return order, 2 - 2 * np.take_along_axis(score, order, axis=1)


def _replicas(graph: CentroidGraph, order: np.ndarray, distance: np.ndarray, ratio: float, most: int) -> np.ndarray:
    """Which of the found centroids keep a copy of a vector."""
    keep = distance <= np.maximum(distance[:, :1], 1e-12) * ratio**2
    keep[:, most:] = False
    for j in range(1, min(most, order.shape[1])):
        # not where a kept nearer centroid lies nearer to this one than the vector does
        own = graph.centroids[order[:, j]]
        for i in range(j):
            between = 2 - 2 * np.einsum("nd,nd->n", graph.centroids[order[:, i]], own)
            keep[:, j] &= ~(keep[:, i] & (between < distance[:, j]))
    keep[:, 0] = True
    return keep


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very small and very large components keep their direction
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, each summed on its own, so equal pairs have equal values wherever they stand."""
    return (_unit(x) * _unit(y)).sum(axis=1)


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    replica_ratio: float = 1.2,
    most_replicas: int = 4,
    probe_ratio: float = 1.35,
    least_probes: int = 12,
    most_probes: int = 64,
    sample_size: int = SAMPLE,
    list_vectors: int = LIST_VECTORS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for every row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), is_query.alias("asks"))
    named = named.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("asks", F.coalesce("asks", F.lit(False)))
    lengths = named.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    named = named.filter(F.size("v") == lengths["length"])
    lists = min(MAX_LISTS, max(1, lengths["count"] // list_vectors))
    sample = named.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", "v").limit(max(sample_size, LIST_SAMPLE * lists)).select("v").collect()
    points = _unit(np.array([r.v for r in sample], np.float64))
    graph = CentroidGraph(balanced_centroids(points, lists))
    shared = spark.sparkContext.broadcast(graph)
    # vectors that are searched together: their scores of all centroids are in memory
    rows = max(64, (1 << 20) // len(graph.centroids))

    # equal vectors: the smallest ids are all that can be among the nearest
    own = Window.partitionBy("v").orderBy("vec_id")
    some = named.dropDuplicates(["vec_id", "v"]).withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= k + 1)
    entries = some.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.col("ids")[0])
    asked = named.filter("asks").select("v").distinct()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                order, distance = shared.value.search(_unit(_matrix(part.column("v"))), 2 * most_replicas)
                row, col = np.nonzero(_replicas(shared.value, order, distance, replica_ratio, most_replicas))
                yield pa.RecordBatch.from_arrays([pa.array(order[row, col].astype(np.int32)), *[part.column(c).take(pa.array(row)) for c in ("first", "ids", "v")]], ["list", "first", "ids", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                order, distance = shared.value.search(_unit(_matrix(part.column("v"))), most_probes)
                near = distance <= np.maximum(distance[:, :1], 1e-12) * probe_ratio**2
                near[:, :least_probes] = True
                row, col = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(order[row, col].astype(np.int32)), *[part.column(c).take(pa.array(row)) for c in ("first", "v")]], ["list", "first", "v"])

    posted = common.stored(entries.select("first", "ids", "v").mapInArrow(assign, "list int, first long, ids array<long>, v array<double>"), "ann-posted")
    sizes = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_VECTORS).cast("int").alias("parts"))
    # at most MAX_LISTS rows
    parts = F.broadcast(spark.createDataFrame(sizes.collect(), "list int, parts int"))
    posted = posted.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("first"), "parts").cast("int")).select("list", "part", "first", "ids", "v")
    queries = entries.join(asked, "v", "left_semi").select("first", "v").mapInArrow(probe, "list int, first long, v array<double>")
    queries = queries.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "first", "v")

    def compare(query: pd.DataFrame, posting: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(query) and len(posting):
            own, ids, first = np.stack(posting["v"].to_numpy()), posting["ids"].to_numpy(), posting["first"].to_numpy()
            unit = _unit(own)
            for at in range(0, len(query), 256):
                asking = np.stack(query["v"].to_numpy()[at : at + 256])
                rough = _unit(asking) @ unit.T
                least = np.partition(rough, max(0, len(own) - k - 1), axis=1)[:, max(0, len(own) - k - 1)]
                row, col = np.nonzero(rough >= least[:, None] - 1e-9)
                score = cosine(asking[row], own[col])
                # of each query the best k + 1 entries, ties to the smaller id
                order = np.lexsort((first[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                keep = nth <= k
                row, col, score = row[keep], col[keep], score[keep]
                n_ids = np.array([len(ids[c]) for c in col], np.int64)
                out.append(pd.DataFrame({"asker": np.repeat(query["first"].to_numpy()[at + row], n_ids), "vec_id": np.concatenate([ids[c] for c in col]), "score": np.repeat(score, n_ids)}))
        return pd.concat(out) if out else pd.DataFrame({"asker": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = queries.groupBy("list", "part").cogroup(posted.groupBy("list", "part")).applyInPandas(compare, "asker long, vec_id long, score double")
    by_class = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    best = found.dropDuplicates(["asker", "vec_id"]).withColumn("nth", F.row_number().over(by_class)).filter(F.col("nth") <= k + 1).drop("nth")
    # back to every query of a class, without the query itself
    askers = named.filter("asks").select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id", "v"]).join(entries.select("v", F.col("first").alias("asker")), "v").select("query_id", "asker")
    ranked = Window.partitionBy("query_id", "asker").orderBy(F.desc("score"), "vec_id")
    out = askers.join(best, "asker").filter("query_id != vec_id").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
