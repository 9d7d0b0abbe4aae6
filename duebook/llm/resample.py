"""Quality by importance resampling (Xie et al., 2023): documents are drawn in proportion
to how much likelier their hashed word n-grams are in a target than in the raw text.

Two bag-of-n-gram models over ``BUCKETS`` buckets are counted over all texts: of the
target rows and of all rows. A document's log weight is the sum of its n-grams' log
ratios; Gumbel noise from a hash of its id is added, and the rows with the largest sums
are a sample without replacement. Where the last drawn one lies is found by narrowing
histograms, so that no task sorts or holds all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.common import append_columns, materialise, small_side, text_bytes

BUCKETS = 2 ** 14
SHARE = 0.8             # of the rows that are drawn
BINS = 1024
TAIL = 10_000           # rows of one bin that are ordered


def buckets_of(text: bytes) -> np.ndarray:
    """Buckets of the words (A-Z lower-cased, at ASCII white space) and word pairs."""
    digest = xxhash.xxh64_digest
    one = np.frombuffer(b"".join([digest(w) for w in text.lower().split()]), np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([one, two]) >> np.uint64(64 - 14)).astype(np.int64)


def log_ratios(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, both with one added to every count. `target`
    has the doc_ids of the target rows."""
    listed = small_side(target.select("doc_id").filter("doc_id is not null").distinct()
                        .withColumn("_target", F.lit(True)))

    def run(batches):
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            wanted = batch.column(1).to_pylist()
            for is_target, text in zip(wanted, text_bytes(batch)):
                own = np.bincount(buckets_of(text), minlength=BUCKETS) if text else 0
                sums[0] += own
                if is_target:
                    sums[1] += own
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS)), pa.array(sums[0]), pa.array(sums[1])],
            ["bucket", "raw", "target"])

    marked = docs.select("doc_id", "text").join(listed, "doc_id", "left").select(
        "text", "_target")
    rows = (marked.mapInArrow(run, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect())
    counts = np.zeros((2, BUCKETS))
    for bucket, raw, wanted in rows:
        counts[:, bucket] = raw, wanted
    p = (counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS)
    return np.log(p[1] / p[0])


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """`docs` with n_grams and log_weight; a text without words has 0 of both."""
    sent = docs.sparkSession.sparkContext.broadcast(ratios)

    def make(batches):
        for batch in batches:
            found = [buckets_of(t) for t in text_bytes(batch)]
            yield [[len(f) for f in found],
                   [math.fsum(sent.value[f].tolist()) for f in found]]

    return append_columns(docs, "n_grams long, log_weight double", make, consumed=("text",))


def gumbel(key: Column) -> Column:
    """A Gumbel variate fixed by the key."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit("gumbel")), 11).cast("double") + 0.5) / 2.0 ** 53
    return -F.log(-F.log(u))


def largest(rows: DataFrame, k: int, key: str) -> DataFrame:
    """The k rows of a written frame with the largest `key`, ties to the smaller doc_id.
    Histograms between known bounds narrow down to the bin with the last of them."""
    if k <= 0:
        return rows.limit(0)
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if k >= n:
        return rows
    above, value = 0, F.col(key)
    inside = value.isNotNull()
    while True:
        count = rows.filter(inside).count()
        if count <= TAIL or not low < high:
            break
        width = (high - low) / BINS
        at = F.least(F.floor((value - low) / width), F.lit(BINS - 1)).cast("int")
        bins = dict(rows.filter(inside).groupBy(at.alias("at")).count().collect())
        for last in range(BINS - 1, -1, -1):
            if above + bins.get(last, 0) >= k:
                break
            above += bins.get(last, 0)
        if bins.get(last, 0) == count:
            break
        inside = inside & (at == last)
        low, high = rows.filter(inside).agg(F.min(key), F.max(key)).first()
    edge = rows.filter(inside).orderBy(F.desc(key), "doc_id").limit(k - above)
    return rows.filter(value > high).union(edge)


def resample(docs: DataFrame, target: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_grams, log_weight and gumbel_key of ceil(share * rows) rows drawn from
    `docs`. The noise depends on the doc_id alone; equal rows have equal keys and
    a row each. Null and blank texts weigh 0; rows without doc_id can be drawn too. An
    empty target makes all weights follow the raw text, an empty table gives none."""
    ratios = log_ratios(docs, target)
    weighed = log_weights(docs.select("doc_id", "text"), ratios)
    rows = materialise(weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    return largest(rows, math.ceil(share * rows.count()), "gumbel_key")
