"""Whitening against exact sums in Python and eigenvectors in 200-bit arithmetic."""

import math

import numpy as np
import pytest

from duebook.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, label int"


def vectors(seed=0, n=400, d=6):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.array([3, 1, 1, 0.2, 0.2, 0.01])[:d]
    return (rng.normal(size=(n, d)) @ mix).astype(np.float32)


def plain(rows):
    """x, n, S and the exact covariance times n squared, by Python integers."""
    xs = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in rows]
    n, sums = len(xs), [sum(c) for c in zip(*xs)]
    apart = [[n * a - s for a, s in zip(x, sums)] for x in xs]
    return xs, n, sums, apart


@pytest.fixture(scope="module")
def whitened(spark):
    given = vectors()
    rows = [(i, [float(c) for c in v], "own", 1) for i, v in enumerate(given)]
    rows += [(1000, rows[0][1], "own", 1), (None, rows[1][1], "own", None)]
    odd = [(2000, None, "x", 1), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 1),
           (2002, [float("nan")] * 6, "x", 1), (2003, [float("inf")] * 6, "x", 1),
           (2004, [1.0, 2.0], "x", 1), (2005, [], "x", 1), (2006, [3e38] * 6, "x", 1)]
    found = whitening.whiten(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    return [r[:2] for r in rows], found


def test_rows_and_deviations(whitened):
    rows, found = whitened
    _, n, _, apart = plain([v for _, v in rows])
    want = sorted((-1 if i is None else i, k, sum(a * a for a in x))
                  for (i, _), x in zip(rows, apart) for k in range(1, 7))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component, r.deviation)
                  for r in found) == want
    assert {r.n for r in found} == {n}


def test_components_match_double_eigenvectors(whitened):
    rows, found = whitened
    _, n, _, apart = plain([v for _, v in rows])
    y = np.array(apart, dtype=np.float64) / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    for k in range(6):
        want = y @ basis[:, k] / math.sqrt(values[k])
        by_id = {r.vec_id: r.whitened for r in found if r.component == k + 1}
        got = np.array([by_id[i] for i, _ in rows])
        sign = np.sign(got @ want)
        assert np.abs(got * sign - want).max() < 1e-8
        share = next(r.explained for r in found if r.component == k + 1)
        assert math.isclose(share, values[k] / values.sum(), rel_tol=1e-12)
    assert {r.identity_error for r in found}.pop() < 1e-12


def test_refined_beyond_float32():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 40))
    a = a @ a.T
    values, x = whitening.eigenpairs(a)
    x = x.astype(np.longdouble)
    residual = np.abs(a.astype(np.longdouble) @ x - x * values).max() / values[0]
    assert residual < 4e-16 and np.abs(x.T @ x - np.eye(40)).max() < 4e-16
    assert (np.diff(values) <= 0).all()


@pytest.mark.parametrize("spread", [0.0, 1e-13, 1e-9, 1e-6])
def test_clustered_eigenvalues(spread):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    wanted = np.concatenate([2 + spread * np.arange(8), [5, 5 + spread], np.linspace(0.1, 1, 20)])
    a = (q * wanted) @ q.T
    a = (a + a.T) / 2
    values, x = whitening.eigenpairs(a)
    assert np.abs(values - np.sort(wanted)[::-1]).max() < 1e-14 * 5 * 8
    assert np.abs(a.astype(np.longdouble) @ x - x * values).max() < 4e-15
    assert np.abs(x.T @ x - np.eye(30)).max() < 2e-15
    if spread >= 1e-9:      # distinct: the vectors themselves are those of the cluster
        order = np.argsort(wanted)[::-1]
        assert np.abs(np.abs((x * q[:, order]).sum(axis=0)) - 1).max() < 1e-5


def test_products_of_long_integers():
    rng = np.random.default_rng(4)
    y = rng.integers(-2 ** 52, 2 ** 52, (50, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)]
            for i in range(3)]
    assert whitening.products(y).tolist() == want


def test_large_entries_keep_exact_sums(spark):
    rng = np.random.default_rng(5)
    given = [(i, [float(c) for c in rng.integers(-2 ** 40, 2 ** 40, 3)]) for i in range(30)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>").repartition(5)
    x = whitening.integers(df)
    xs, n, sums, _ = plain([v for _, v in given])
    assert whitening.sums_of(x) == (n, sums)
    centre = [s // n for s in sums]
    found = whitening.product_sums(x, centre)
    assert found[0, 2] == sum((r[0] - centre[0]) * (r[2] - centre[2]) for r in xs)
    assert {r.deviation for r in whitening.whiten(df).collect()} == {None}


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)],
                                 "vec_id long, embedding array<float>")
    found = whitening.whiten(same).collect()
    assert len(found) == 10
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {
        (0, 0.0, 0.0, 0.0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)],
                                 "vec_id long, embedding array<float>")
    found = whitening.whiten(line).collect()
    assert {r.whitened for r in found if r.component == 2} == {0.0}
    assert found[0].identity_error < 1e-12
    for rows in ([], [(1, None), (2, [])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert whitening.whiten(df).count() == 0
