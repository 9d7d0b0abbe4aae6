"""The resolution ladder: published verdicts and properties."""

import random

import pytest
from test_similarity import slow_held, slow_partial, slow_token_set

from duebook.operators import resolve as R
from duebook.sources import schemas


# Least and greatest best score by words, least best score by parts, and what it means.
VERDICTS = ((90, 100, 0, {"match", "ambiguous"}), (72, 90, 0, {"borderline", "ambiguous"}),
            (0, 72, 85, {"suspect"}))


def related(a, b):
    """Too alike for both to be founders."""
    return slow_held(a, b) or len(a) >= 4 and (
        slow_token_set(a, b) >= 72 or slow_partial(a, b) >= 85)


def allowed_verdicts(name, known):
    """By the scores against the known names."""
    if not any(related(name, k) for k in known):
        return {"unknown"}
    words = max((slow_token_set(name, k) for k in known), default=0) if len(name) >= 4 else 0
    parts = max((slow_partial(name, k) for k in known), default=0) if len(name) >= 4 else 0
    for least, most, least_parts, verdicts in VERDICTS:
        if least <= words and (words < most or most == 100) and parts >= least_parts:
            return verdicts
    return {"suspect"}


def make_state(spark, txn_rows, merchants=(), aliases=(), queue=()):
    rows = [(u, 1, None, -100, "USD", s, s, None, "f", f"{u}-{i}")
            for i, (u, s) in enumerate(txn_rows)]
    return R.State(spark.createDataFrame(rows, schemas.TRANSACTION),
                   spark.createDataFrame([(u, m, None) for u, m in merchants], schemas.MERCHANT),
                   spark.createDataFrame(list(aliases), schemas.MERCHANT_ALIAS),
                   spark.createDataFrame(list(queue), schemas.RESOLUTION_QUEUE))


WORDS = ["COFFEE", "BLUE", "BOTTLE", "NETFLIX", "AMAZON", "AMZN", "PRIME", "HBO", "MAX", "HBOMAX",
         "SHOP", "SHOPPE", "A", "AB", "WEB", "SERVICES", "GOOGLE", "YOUTUBE", "YOUTUBEPREMIUM"]


def random_counts(rng, n):
    out = {}
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.3:
            words[0] = "".join(rng.choice("ABCDEFGH") for _ in range(rng.randint(1, 9)))
        out[" ".join(words)] = rng.randint(1, 4)
    return out


PUBLISHED = [
    ("NETFLIX ASSOCIATES", ["NETFLIX", "SPOTIFY", "AMAZON WEB SERVICES"], "match"),
    ("COFFEE", ["PHILZ COFFEE", "BLUE BOTTLE COFFEE"], "ambiguous"),
    ("TRADER JOES", ["NETFLIX", "SPOTIFY", "PHILZ COFFEE", "BLUE BOTTLE"], "unknown"),
    ("CA", ["NETFLIX", "SPOTIFY"], "unknown"),
    ("AMZN PRIME MEMBERSHIP", ["AMAZON PRIME", "CHEVRON"], "suspect"),
    ("GOOGLE YOUTUBEPREMIUM", ["GOOGLE YOUTUBE PREMIUM", "CHEVRON"], "suspect"),
    ("HBOMAX", ["WARNERMEDIA HBO MAX", "CHEVRON"], "suspect"),
    ("AWS", ["AWS EMEA", "LAWSON"], "unknown"),
]


def test_published_verdicts(spark):
    txns = [(i, s) for i, (s, _, _) in enumerate(PUBLISHED)]
    known = [(i, k) for i, (_, ks, _) in enumerate(PUBLISHED) for k in ks]
    _, outcomes = R.resolve(make_state(spark, txns, known))
    got = {r.user_id: r.verdict for r in outcomes.collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(PUBLISHED)}


@pytest.mark.parametrize("batch,tile", [(1000, 1000), (6, 7)])
def test_ladder_properties(spark, batch, tile):
    """Founders are unlike every older name, everything else is like one; verdicts and
    candidates follow the scores. Small batches and tiles change nothing."""
    rng = random.Random(11)
    tenants = {u: random_counts(rng, 4 + 6 * u) for u in range(5)}
    existing = {u: ["COFFEE BLUE", "XYLOPHONE", "ABC"][:u % 4] for u in tenants}
    txns = [(u, s) for u, counts in tenants.items() for s, n in counts.items() for _ in range(n)]
    state = make_state(spark, txns, [(u, m) for u, ms in existing.items() for m in ms])
    after, outcomes = R.resolve(state, batch, tile)
    got = {(r.user_id, r.scrubbed): r for r in outcomes.collect()}
    assert len(got) == sum(map(len, tenants.values()))
    for u, counts in tenants.items():
        rank = {s: (-n, s) for s, n in counts.items()}
        founders = {s for s in counts if got[u, s].tier == "new"}
        for s in counts:
            r = got[u, s]
            older = existing[u] + [f for f in founders if rank[f] < rank[s]]
            assert r.n == counts[s]
            assert (s in founders) == (not any(related(s, k) for k in older)), (u, s)
            assert r.verdict in allowed_verdicts(s, older), (u, s)
            assert r.tier == {"match": "fuzzy", "unknown": "new"}.get(r.verdict, "queued")
            if r.verdict == "unknown":
                continue
            scores = [c.score for c in r.candidates]
            score = slow_partial if r.verdict == "suspect" else slow_token_set
            assert scores and all(abs(score(s, c.name) - c.score) < 1e-9 for c in r.candidates)
            assert {c.name for c in r.candidates} <= set(older)
            if r.verdict != "suspect":
                assert scores == sorted(scores, reverse=True)
                assert abs(scores[0] - max(slow_token_set(s, k) for k in older)) < 1e-9
                close = len(scores) > 1 and scores[1] >= 72 and scores[0] - scores[1] <= 4
                assert close == (r.verdict == "ambiguous")
    names = {(r.user_id, r.canonical_name) for r in after.merchants.collect()}
    assert names == {(r.user_id, r.merchant) for r in got.values() if r.tier == "new"} | {
        (u, m) for u, ms in existing.items() for m in ms}
    linked = {(r.user_id, r.scrubbed): r.merchant for r in after.transactions.collect()}
    assert all(linked[k] == r.merchant for k, r in got.items())
    assert after.transactions.count() == len(txns)
    assert {(r.user_id, r.scrubbed) for r in after.queue.collect()} == {
        k for k, r in got.items() if r.tier == "queued"}
    # A second run finds only what waits for a person, and changes nothing.
    again, outcomes = R.resolve(after)
    assert {r.tier for r in outcomes.collect()} <= {"queued"}
    assert again.merchants.count() == after.merchants.count()


def test_rounds_found_as_the_sequential_rule(spark, monkeypatch):
    rng = random.Random(5)
    counts = {u: random_counts(rng, 150) for u in (1, 2)}
    counts[3] = {f"MERCHANT NUMBER {i}": 200 - i for i in range(120)}       # all alike
    rows = [(u, s, n) for u, c in counts.items() for s, n in c.items()]
    needles = spark.createDataFrame(rows, "user_id long, scrubbed string, n long")
    none = spark.createDataFrame([], schemas.MERCHANT)
    rounds = []
    one = R.found_round
    monkeypatch.setattr(R, "found_round", lambda *a: rounds.append(1) or one(*a))
    got = {(r.user_id, r.scrubbed) for r in R.select_founders(needles, none, 20, 13).collect()}
    want = set()
    for u, c in counts.items():
        chosen = []
        for s in sorted(c, key=lambda s: (-c[s], s)):
            if not any(related(s, k) for k in chosen):
                chosen.append(s)
        want |= {(u, s) for s in chosen}
    assert got == want
    assert 1 < len(rounds) < 10


def test_alias_pending_and_decisions(spark):
    import datetime as dt
    cand = [("NETFLIX", 80.0)]
    state = make_state(
        spark, [(1, "OLD ALIAS")] * 3 + [(1, "WAITING"), (1, "SKIPPED"), (1, "NEWCOMER"), (2, "X")],
        [(1, "NETFLIX")],
        [(1, "OLD ALIAS", "NETFLIX", "fuzzy", 0.95)],
        [(1, "WAITING", 7, cand, 80.0, "borderline", "pending"),
         (1, "SKIPPED", 1, cand, 80.0, "borderline", "ignored")])
    after, outcomes = R.resolve(state)
    tiers = {(r.user_id, r.scrubbed): r.tier for r in outcomes.collect()}
    assert tiers == {(1, "OLD ALIAS"): "exact", (1, "WAITING"): "queued", (1, "SKIPPED"): "new",
                     (1, "NEWCOMER"): "new", (2, "X"): "new"}
    queue = {r.scrubbed: r for r in after.queue.collect()}
    assert queue["WAITING"].txn_count == 7 and queue["SKIPPED"].status == "ignored"
    stats = {(r.user_id, r.tier): r.transactions for r in R.tier_stats(outcomes).collect()}
    assert stats == {(1, "exact"): 3, (1, "queued"): 1, (1, "new"): 2, (2, "new"): 1}

    t = [dt.datetime(2026, 1, d) for d in (1, 2)]
    answers = spark.createDataFrame(
        [(1, "WAITING", "  NETFLIX ", False, t[1]), (1, "WAITING", None, True, t[0]),
         (1, "OLD ALIAS", "ELSEWHERE", False, t[0]), (2, "WAITING", "X", False, t[0])],
        schemas.DECISION)
    done = R.apply_decisions(after, answers)
    merchant = {(r.user_id, r.scrubbed): r.merchant for r in done.transactions.collect()}
    assert merchant[1, "WAITING"] == "NETFLIX" and merchant[1, "OLD ALIAS"] == "NETFLIX"
    alias = {(r.user_id, r.scrubbed_pattern): r for r in done.aliases.collect()}
    assert alias[1, "WAITING"].resolved_by == "human"
    assert alias[1, "OLD ALIAS"].resolved_by == "fuzzy"
    assert {r.scrubbed: r.status for r in done.queue.collect()} == {
        "WAITING": "resolved", "SKIPPED": "ignored"}
    blank = spark.createDataFrame([(1, "WAITING", "   ", False, t[0])], schemas.DECISION)
    assert R.apply_decisions(after, blank).queue.filter("status = 'pending'").count() == 1
