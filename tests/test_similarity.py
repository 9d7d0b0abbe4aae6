"""Scores against a plain dynamic-programming restatement of their definition."""

import random

import numpy as np
import pytest

from duebook.functions import similarity as sim


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def norm(dist, total):
    return 100 - 100 * dist / total


def slow_token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    da, db = " ".join(sorted(x - both)), " ".join(sorted(y - both))
    if both and (not da or not db):
        return 100.0
    s = len(" ".join(sorted(both)))
    sp = 1 if s else 0
    la, lb = s + sp + len(da), s + sp + len(db)
    scores = [norm(len(da) + len(db) - 2 * lcs(da, db), la + lb)]
    if s:
        scores += [norm(sp + len(da), s + la), norm(sp + len(db), s + lb)]
    return max(scores)


def slow_partial(a, b):
    def one(x, y):
        m = len(x)
        windows = [y[:k] for k in range(1, m)] + [y[k:k + m] for k in range(len(y))]
        return max((1 - (m + len(w) - 2 * lcs(x, w)) / (m + len(w))) * 100
                   for w in windows)
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    return max(one(a, b), one(b, a)) if len(a) == len(b) else one(a, b)


def slow_held(a, b):
    a, b = a.replace(" ", ""), b.replace(" ", "")
    return len(a) >= 5 and len(b) >= 5 and (a in b or b in a)


def slow_related(a, b):
    return len(a) >= 4 and (slow_token_set(a, b) >= 72 or slow_partial(a, b) >= 85
                            or slow_held(a, b))


def word(rng):
    return "".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 7)))


def name(rng):
    return rng.choice(["", " "]).join(word(rng) for _ in range(rng.randint(0, 4)))


def test_published_scores():
    pairs = [("AMZN PRIME MEMBERSHIP", "AMAZON PRIME", 61, 91),
             ("GOOGLE YOUTUBEPREMIUM", "GOOGLE YOUTUBE PREMIUM", 65, 95),
             ("HBOMAX", "WARNERMEDIA HBO MAX", 48, 83)]
    at = np.arange(len(pairs))
    left, right = [p[0] for p in pairs], [p[1] for p in pairs]
    assert [round(x) for x in sim.token_set(left, right, at, at)] == [p[2] for p in pairs]
    assert [round(x) for x in sim.partial(left, right, at, at)] == [p[3] for p in pairs]
    assert sim.held(left, right, at, at).tolist() == [False, True, True]


@pytest.mark.parametrize("seed", range(4))
def test_against_definition(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(sim, "PAIRS_AT_ONCE", 100)
        monkeypatch.setattr(sim, "ROWS_AT_ONCE", 7)
    rng = random.Random(seed)
    left = [name(rng) for _ in range(40)] + ["X" * 70 + " AB", "ABCD" * 16]
    right = [name(rng) for _ in range(40)] + ["X" * 66, "ABCD" * 16 + "E"]
    ia, ib = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right))))
    pairs = [(left[i], right[j]) for i, j in zip(ia, ib)]
    assert np.allclose(sim.token_set(left, right, ia, ib), [slow_token_set(*p) for p in pairs])
    assert np.allclose(sim.partial(left, right, ia, ib), [slow_partial(*p) for p in pairs])
    assert sim.related(left, right, ia, ib).tolist() == [slow_related(*p) for p in pairs]


def test_columns(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("HBOMAX", "WARNERMEDIA HBO MAX"), ("AWS", "LAWSON"),
                                (None, "X")], "a string, b string")
    rows = df.select(F.round(sim.token_set_score("a", "b"), 1),
                     F.round(sim.partial_score("a", "b"), 1),
                     sim.held_column(F.col("a"), F.col("b"))).collect()
    assert tuple(rows[0]) == (48.0, 83.3, True)
    assert rows[1][2] is False and rows[2][0] == 0.0


def assorted_names(rng, n):
    stems = ["NETFLIX", "AMAZON PRIME", "PAYPAL", "CAFÉ RIO", "ANANAS", "HBO MAX", "A B C D", "ÅÄÖ"]
    out = ["", " ", "A", "ABC", "AAAA AAAA", "X" * 70, "X" * 69 + " Y"]
    while len(out) < n:
        name = rng.choice(stems) if rng.random() < 0.6 else "".join(
            rng.choice("ABCDEF ") for _ in range(rng.randint(1, 18)))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(name) + 1)
            name = name[:at] + rng.choice(["", "X", " ", "NE", "Q"]) + name[at + rng.randrange(2):]
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_no_related_pair_is_left_out(seed):
    rng = random.Random(seed)
    left, right = assorted_names(rng, 60), assorted_names(rng, 70)
    both = sim.Comparison(left, right)
    maybe = both.candidates(slice(0, len(left)))
    want = np.array([[slow_related(a, b) for b in right] for a in left])
    assert not (want & ~maybe).any()
    assert (both.flags() == want.any(axis=1)).all()
    allowed = np.array([[(i + j) % 3 > 0 for j in range(len(right))] for i in range(len(left))])
    assert (both.flags(lambda rows: allowed[rows]) == (want & allowed).any(axis=1)).all()


@pytest.mark.parametrize("seed", range(4))
def test_bounds_and_best(seed):
    rng = random.Random(40 + seed)
    left, right = assorted_names(rng, 50), assorted_names(rng, 64)
    both = sim.Comparison(left, right)
    common, letters, pairs = both.shared_block(slice(0, len(left)))
    i, j = np.arange(len(left))[:, None], np.arange(len(right))[None, :]
    for slow, score, bound in (
            (slow_token_set, both.token_set, both.token_bound(common, letters, i, j)),
            (slow_partial, both.partial, both.partial_bound(letters, pairs, i, j))):
        exact = np.array([[slow(a, b) for b in right] for a in left])
        assert (exact <= bound).all()
        limits = np.where((i + j) % 5 > 0, bound, -np.inf)
        ia, ib, got = both.best(score, limits, np.arange(len(left)), 4)
        for row in range(len(left)):
            order = sorted((-exact[row, c], c) for c in range(len(right)) if (row + c) % 5)
            # Scores that differ by rounding only may change places.
            assert np.allclose(got[ia == row], [-s for s, _ in order[:4]], atol=1e-9)
            assert np.allclose(exact[row, ib[ia == row]], got[ia == row], atol=1e-9)


def test_random_names_leave_few_candidates():
    rng = random.Random(9)
    names = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(rng.randint(8, 18)))
             for _ in range(1500)]
    both = sim.Comparison(names, names)
    share = np.mean([both.candidates(slice(at, at + 256)).mean() for at in range(0, 1500, 256)])
    assert share < 0.02
