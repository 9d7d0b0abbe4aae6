"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Each shard of vectors posts them
in inverted files, one for each pivot, with the pivot's place; a query goes through the
files of its own pivots and adds up the footrule distance to every vector met, and the
nearest by that measure are ranked anew by the exact inner product. Shards and blocks of
queries have a bounded size, and each pair of the two is a task's group: a stated query
set against all rows.

Largest inner products are made nearest neighbours by one more dimension that gives all
vectors the length of the longest. Equal vectors are one entry of the index with its
smallest ids, as many as a result could hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duebook.llm.common import materialise

PIVOTS = 256            # vectors the index is fitted on
PLACES = 64             # pivots a vector is posted under
SHARD = 16_384
QUERY_BLOCK = 8_192
RERANK = 0.3            # share of a shard that is ranked anew
LEAST = 2_000           # and at least so many
NEAREST = 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part: not null, not zero, all
    components finite, of the most frequent length, with a vec_id."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(
        "vec_id is not null and size(vector) > 0 and forall(vector, x -> x is not null and "
        "not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x != 0)")
    rows = materialise(rows.distinct())
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(
        F.desc("count"), "n").first()
    return rows if sizes is None else rows.filter(F.size("vector") == sizes["n"])


def places(points: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The numbers of the m pivots with the largest inner products, in order."""
    near = -(points @ pivots.T)
    first = np.argpartition(near, m - 1, axis=1)[:, :m] if m < len(pivots) else np.tile(
        np.arange(m), (len(points), 1))
    order = np.argsort(np.take_along_axis(near, first, 1), axis=1, kind="stable")
    return np.take_along_axis(first, order, 1)


class InvertedFiles:
    """For each pivot the vectors posted under it and their m - place."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        n, self.m = orders.shape
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        self.vectors = (by_pivot // self.m).astype(np.int32)
        self.left = (self.m - by_pivot % self.m).astype(np.float64)
        self.cuts = np.concatenate([[0], np.cumsum(np.bincount(orders.ravel(),
                                                               minlength=n_pivots))])
        self.n = n

    def nearness(self, order: np.ndarray) -> np.ndarray:
        """A constant less half the footrule distance to each vector: a pivot that both
        have at places i and j brings it down by 2 (m - max(i, j))."""
        met, gains = [], []
        for i, pivot in enumerate(order.tolist()):
            a, b = self.cuts[pivot], self.cuts[pivot + 1]
            met.append(self.vectors[a:b])
            gains.append(np.minimum(self.left[a:b], self.m - i))
        return np.bincount(np.concatenate(met), np.concatenate(gains), minlength=self.n)


def search(ids: list, points: np.ndarray, lifted: np.ndarray, query_ids: list,
           queries: np.ndarray, pivots: np.ndarray, k: int, rerank: float, least: int):
    """Rows (query_id, vec_id, score): each query's k nearest of one shard."""
    m = min(PLACES, len(pivots))
    files = InvertedFiles(places(lifted, pivots, m), len(pivots))
    n = len(points)
    keep = min(n, max(least, int(np.ceil(rerank * n))))
    sizes = np.array([len(x) for x in ids])
    flat = np.concatenate(ids)
    starts = np.cumsum(sizes) - sizes
    lengths = np.linalg.norm(queries, axis=1, keepdims=True)
    asked = places(np.hstack([queries / lengths, np.zeros((len(queries), 1))]), pivots, m)
    out = []
    for own, query, order in zip(query_ids, queries, asked):
        if keep < n:
            near = files.nearness(order) * n - np.arange(n)
            found = np.argpartition(-near, keep - 1)[:keep]
        else:
            found = np.arange(n)
        score = points[found] @ query
        if len(found) > 2 * k:
            edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            found, score = found[score >= edge], score[score >= edge]
        each = np.repeat(score, sizes[found])
        who = np.concatenate([flat[starts[f]:starts[f] + sizes[f]] for f in found])
        other = who != own
        each, who = each[other], who[other]
        best = np.lexsort((who, -each))[:k]
        out.append((np.full(len(best), own), who[best], each[best]))
    return [np.concatenate(x) for x in zip(*out)]


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, rerank: float = RERANK,
            least: int = LEAST, shard_rows: int = SHARD,
            block_rows: int = QUERY_BLOCK) -> DataFrame:
    """For each row of `vectors` (vec_id, embedding) that `is_query` picks: query_id, rank,
    vec_id, score of its k nearest other rows by inner product, ties to the smaller
    vec_id. Rows that `usable` leaves out take no part; fewer candidates than k are all
    given; rows equal in both columns count once."""
    rows = usable(vectors)
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    entries = materialise(
        rows.withColumn("_at", F.row_number().over(by_id)).filter(F.col("_at") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))))
    n, longest = entries.agg(F.count("*"), F.max("norm")).first()
    asked = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector")
    schema = "query_id long, vec_id long, score double"
    if not n:
        return asked.sparkSession.createDataFrame(
            [], "query_id long, rank int, vec_id long, score double")
    sample = entries.orderBy(F.xxhash64("vector"), F.col("ids")[0]).limit(PIVOTS).select(
        "vector").collect()

    def lift(points):
        unit = points / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(1)))
        return np.hstack([unit, rest[:, None]])

    pivots = lift(np.array([r[0] for r in sample]))
    shards = -(-n // shard_rows)
    blocks = max(1, -(-asked.count() // block_rows))
    index = (entries.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    probes = (asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
              .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"),
                                                        F.lit(shards - 1).cast("long")))))

    def run(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left = left.iloc[np.argsort([x[0] for x in left["ids"]], kind="stable")]
        points = np.stack(left["vector"].to_list())
        found = search(left["ids"].to_list(), points, lift(points),
                       right["query_id"].to_list(), np.stack(right["vector"].to_list()),
                       pivots, k, rerank, least)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    found = (index.select("shard", "block", "vector", "ids").groupBy("shard", "block")
             .cogroup(probes.groupBy("shard", "block")).applyInPandas(run, schema))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
