"""Embedding whitening: components of the exact covariance, from float32 eigenvectors that are
refined in higher precision.

Vectors become integers, so their sums and the sums of products of centred integers are
exact, whatever the partitions: tasks multiply digits of 20 bits, whose sums of 4,096
products a double holds exactly, and Spark adds the tasks' matrices up entry by entry. What
reaches the driver is the covariance (dimensions squared), never rows.

There, eigenvectors are worked out in float32 and corrected by the iterations of Ogita and
Aishima (2018) in extended precision: each is a few matrix products and squares the error.
Eigenvalues that lie closer together than the current error cannot be told apart by such a
step; they are taken as a cluster, for which a small problem is solved in their own
subspace, shifted by the cluster's mean (the second part of their work, 2019).
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1024
SHIFT = 100_000
LARGEST = 2.0 ** 43     # entries from here on have no x whose steps are exact doubles
COMPONENTS = 8
DIGIT = 20
ROWS = 4096
LIMB = 60


class Fit(NamedTuple):
    """n vectors, their sums S, the rounded means m, the sums s of x - m, and of the first
    components: eigenvectors (columns), eigenvalues, shares of the trace."""
    n: int
    sums: list[int]
    centre: list[int]
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


# ------------------------------------------------------- exact covariance --
def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part: no null and no entry that is null, NaN,
    infinite or beyond 2^43, and as long as most vectors are (of equally frequent lengths
    the shorter)."""
    good = rows.select("vec_id", "embedding").filter(
        F.col("embedding").isNotNull() & F.forall("embedding", lambda c: F.coalesce(
            F.abs(c.cast("double")) < F.lit(LARGEST), F.lit(False))))
    lengths = (good.groupBy(F.size("embedding").alias("d")).count()
               .orderBy(F.desc("count"), "d").first())
    d = lengths["d"] if lengths else 0
    return good.filter(F.size("embedding") == d).select("vec_id", F.transform(
        "embedding", lambda c: F.floor(c.cast("double") * SCALE) + SHIFT).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def filled(batches):
    return (b for b in batches if b.num_rows)


def digits(y: np.ndarray) -> list[np.ndarray]:
    """y as doubles d0 + d1 2^20 + ...; the last one has the sign."""
    out = []
    while True:
        low = y & (2 ** DIGIT - 1)
        if (np.abs(y) < 2 ** DIGIT).all():
            return [*out, y.astype(np.float64)]
        out.append(low.astype(np.float64))
        y = y >> DIGIT


def products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers; y has at most ROWS rows."""
    parts = digits(y)
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) * 2 ** (DIGIT * (i + j))
    return total


def summed(rows: DataFrame, partial, names: list[str]) -> dict:
    """Sums over all tasks of integers that `partial` yields as {(i, j): value}; each is sent
    in two limbs, so that decimals hold the sums."""
    def run(batches):
        total: dict = {}
        for batch in filled(batches):
            for key, value in partial(batch):
                total[key] = total.get(key, 0) + value
        if total:
            whole = [int(v) for v in total.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in total], pa.int32()),
                 pa.array([k[1] for k in total], pa.int32()),
                 pa.array([Decimal(v >> LIMB) for v in whole], pa.decimal128(38)),
                 pa.array([v & 2 ** LIMB - 1 for v in whole], pa.int64())], ["i", "j", *names])

    high, low = names
    found = rows.select("x").mapInArrow(run, f"i int, j int, {high} decimal(38,0), {low} long")
    found = found.groupBy("i", "j").agg(
        F.sum(high).alias(high), F.sum(F.col(low).cast("decimal(28,0)")).alias(low)).collect()
    return {(r["i"], r["j"]): (int(r[high]) << LIMB) + int(r[low]) for r in found}


def sums_of(rows: DataFrame) -> tuple[int, list[int]]:
    def partial(batch):
        x = matrix(batch.column(0))
        yield (-1, -1), len(x)
        high, low = (x >> 32).sum(axis=0), (x & 2 ** 32 - 1).sum(axis=0)
        for i in range(x.shape[1]):
            yield (i, -1), (int(high[i]) << 32) + int(low[i])

    found = summed(rows, partial, ["high", "low"])
    n = found.pop((-1, -1), 0)
    return n, [found[i, -1] for i in range(len(found))]


def product_sums(rows: DataFrame, centre: list[int]) -> dict:
    d = len(centre)
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def partial(batch):
        y = matrix(batch.column(0)) - np.array(centre, dtype=np.int64)
        total = np.zeros((d, d), dtype=object)
        for at in range(0, len(y), ROWS):
            total += products(y[at:at + ROWS])
        for i, j in upper:
            yield (i, j), total[i, j]

    return summed(rows, partial, ["high", "low"])


def extended(value: Fraction) -> np.longdouble:
    high = float(value)
    return np.longdouble(high) + np.longdouble(float(value - Fraction(high)))


# ------------------------------------------------------------- refinement --
def clusters(values: np.ndarray, gap) -> list[np.ndarray]:
    """Places of values that chain together by differences of at most `gap`."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [x for x in np.split(order, cuts) if len(x) > 1]


def refine_step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of approximate eigenvectors x of the symmetric a; also the
    eigenvalues it saw and how large it was. All in the precision of the arguments."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: np.sqrt((m * m).sum())
    gap = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= gap
    # r/2 makes the vectors orthonormal, the other, skew part turns them.
    turn = (s + s.T) / 2 + (values[None, :] + values[:, None]) / 2 * r
    e = r / 2 + np.where(near, 0, turn / np.where(near, 1, apart))
    x = x + x @ e
    for group in clusters(values, gap):
        own = x[:, group]
        mean = values[group].mean()
        small = own.T @ (a @ own) - mean * (own.T @ own)
        small = (small + small.T) / 2
        turn = np.linalg.eigh(small.astype(np.float64))[1].astype(a.dtype)
        own = own @ turn
        # The turn is orthogonal to double precision only.
        x[:, group] = own + own @ (np.eye(len(group), dtype=a.dtype) - own.T @ own) / 2
    return x, values, float(norm(e))


def eigenpairs(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to
    double precision; each vector's largest entry is positive."""
    a = a.astype(np.longdouble)
    size = np.abs(a).max() if a.size else 0
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    before = np.inf
    for _ in range(rounds):
        x, _, change = refine_step(a, x)
        if change < 1e-17 or change >= before and change < 1e-15:
            break
        before = change
    x = x + x @ (np.eye(len(a), dtype=a.dtype) - x.T @ x) / 2
    values = np.diag(x.T @ (a @ x)) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.where(np.take_along_axis(x, np.abs(x).argmax(axis=0)[None, :], 0) < 0, -1, 1)
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of `rows` (x array<long>), all equally long; None without rows."""
    n, sums = sums_of(rows)
    if not sums:
        return None
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]
    found = product_sums(rows, centre)
    d = len(sums)
    covariance = np.zeros((d, d), dtype=np.longdouble)
    for (i, j), value in found.items():
        covariance[i, j] = covariance[j, i] = extended(
            Fraction(n * value - rest[i] * rest[j], n * n))
    values, vectors = eigenpairs(covariance)
    trace = float(np.trace(covariance))
    k = min(components, d)
    # A direction without variance has rounding for an eigenvalue.
    values = np.where(values > trace * d * 2.0 ** -60, values, 0.0)[:k]
    share = values / trace if trace else np.zeros(k)
    return Fit(n, sums, centre, rest, vectors[:, :k], values, share)


# -------------------------------------------------------------- whitening --
def projected(model: Fit, x: np.ndarray) -> np.ndarray:
    weights = model.vectors / np.sqrt(np.where(model.values > 0, model.values, np.inf))
    y = (x - np.array(model.centre, dtype=np.int64)).astype(np.float64)
    return (y - np.array([r / model.n for r in model.rest])) @ weights


def deviations(model: Fit, x: np.ndarray) -> list[int | None]:
    """Sums of (n x - S)^2; null where a long does not hold it."""
    y = x - np.array(model.centre, dtype=np.int64)
    most = (int(np.abs(y).max(initial=0)) + 1) * model.n
    if most * most * x.shape[1] < 2 ** 63:
        apart = model.n * y - np.array(model.rest, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = model.n * y.astype(object) - np.array(model.rest, dtype=object)
    return [v if v < 2 ** 63 else None for v in (apart * apart).sum(axis=1)]


def identity_error(rows: DataFrame, model: Fit) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, over the
    components that have a variance."""
    k = len(model.values)

    def run(batches):
        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in filled(batches):
            z = projected(model, matrix(batch.column(0)))
            total += z.sum(axis=0)
            squares += z.T @ z
        values = np.concatenate([total[None, :], squares])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k + 1), k), pa.int32()),
             pa.array(np.tile(np.arange(k), k + 1), pa.int32()),
             pa.array(values.ravel())], ["i", "j", "v"])

    found = (rows.select("x").mapInArrow(run, "i int, j int, v double")
             .groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    values = np.zeros((k + 1, k))
    for r in found:
        values[r["i"], r["j"]] = r["v"] / model.n
    kept = model.values > 0
    error = values[1:] - np.outer(values[0], values[0]) - np.eye(k)
    return float(np.abs(error[np.ix_(kept, kept)]).max(initial=0.0))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row
    of `rows` (vec_id, embedding) that takes part, and each of the first components.

    An entry c counts as x = floor(1024 c) + 100000. Rows without a vector, or with an
    entry that is null, NaN, infinite or beyond 2^43, or of another length than most
    vectors, take no part; repeated rows and a null vec_id are rows like others. Columns
    beside the two are not looked at. A component without variance (fewer rows than
    dimensions, or all equal) whitens to 0 and explains 0. Vectors without entries have no
    component, an empty table gives no rows. A deviation beyond a long is null."""
    schema = (f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, "
              "deviation long, whitened double, explained double, identity_error double")
    x = integers(rows)
    model = fit(x, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(x, model)
    k = len(model.values)

    def run(batches):
        for batch in filled(batches):
            values = matrix(batch.column(1))
            m = len(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, model.n)),
                 pa.array(deviations(model, values), pa.int64()).take(
                     pa.array(np.repeat(np.arange(m), k))),
                 pa.array(projected(model, values).ravel()),
                 pa.array(np.tile(model.explained, m)),
                 pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained",
                 "identity_error"])

    return x.mapInArrow(run, schema)
