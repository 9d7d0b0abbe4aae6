"""Substring dedup against a plain search of all windows."""

import random

import numpy as np
import pytest

from duebook.llm import bitfilter, spans

SCHEMA = "doc_id long, text string, n_words string, _id long, _key long, starts int, n_chars long"


def plain(rows, window):
    """Words kept and removed of each (doc_id, text), ids distinct."""
    first, later = {}, {}
    for doc_id, text in sorted(rows):
        words = (text or "").encode().split()
        later[doc_id] = set()
        for k in range(len(words) - window + 1):
            if first.setdefault(tuple(words[k:k + window]), (doc_id, k)) != (doc_id, k):
                later[doc_id].update(range(k, k + window))
    return {i: [w for k, w in enumerate((t or "").encode().split()) if k not in later[i]]
            for i, t in rows}


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "c", "dé", "e"] + [f"w{i}" for i in range(30)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [draw(rng.randrange(10, 60)) for _ in range(6)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += rng.choice(shared) if rng.random() < 0.5 else draw(rng.randrange(40))
        rows.append((i * 3, rng.choice([" ", "  ", "\n", " \t"]).join(text)))
    rows += [(500 + i, " ".join(["same"] * n)) for i, n in enumerate((19, 20, 21, 60, 5000))]
    rows += [(600, " ".join(["x", "y"] * 40)), (601, " ".join(["x", "y"] * 12)), (602, None),
             (603, ""), (604, " \n\t "), (605, " ".join(draw(20_000)))]
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "own", 7, 8, 9, 1) for r in rows], SCHEMA).repartition(5)
    return spans.dedup_spans(df, **{"bits": 16, **how})


@pytest.mark.parametrize("seed,how", [
    (1, {}), (2, {"shard_fragments": 3}), (3, {"window": 9, "anchor": 2}),
    (4, {"bits": 10, "window": 12, "anchor": 5, "shard_fragments": 20})])
def test_equals_plain_search(spark, seed, how):
    rows = corpus(seed)
    want = plain(rows, how.get("window", 20))
    found = run(spark, rows, **how).collect()
    texts = dict(rows)
    assert len(found) == len(rows)
    for r in found:
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.text or "").encode().split() == want[r.doc_id]
        assert (r.n_words, r.n_removed) == (len(words), len(words) - len(want[r.doc_id]))
        assert (r.text is None) == (texts[r.doc_id] is None)
        gone = [k for s in r.spans for k in range(s.start, s.stop)]
        assert [w for k, w in enumerate(words) if k not in set(gone)] == want[r.doc_id]
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
        assert r.n_chars == (1 if r.text is None else len(r.text)) and (r._id, r.starts) == (7, 9)


def test_null_ids_and_repeated_rows(spark):
    long = " ".join(f"t{i}" for i in range(30))
    rows = [(None, long), (4, long), (4, long), (9, "z " + long), (9, "other"), (9, "other")]
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.text)
                   for r in run(spark, rows).collect())
    assert found == [(-1, long), (4, ""), (4, ""), (9, "other"), (9, "other"), (9, "z")]


def test_empty_table(spark):
    assert run(spark, [(1, "a")]).filter("doc_id > 1").count() == 0
    df = spark.createDataFrame([], "doc_id long, text string")
    out = spans.dedup_spans(df)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_words", "n_removed", "spans"]


def test_automaton_knows_every_substring():
    rng = random.Random(6)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    automaton = spans.SuffixAutomaton()
    for s in sequences:
        automaton.add(s)
    whole, places = [], []
    for s in sequences:
        places.append(len(whole))
        whole.extend(s)
    for _ in range(20):
        asked = [rng.randrange(4) for _ in range(25)]
        for end, (matched, first) in enumerate(automaton.statistics(asked, 6)):
            hits = {}
            for s, begin in zip(sequences, places):
                for k in range(len(s)):
                    for n in range(1, 7):
                        if k + n <= len(s):
                            hits.setdefault(tuple(s[k:k + n]), begin + k + n - 1)
            best = max((n for n in range(1, min(6, end + 1) + 1)
                        if tuple(asked[end - n + 1:end + 1]) in hits), default=0)
            assert matched == best
            if best:
                assert first == hits[tuple(asked[end - best + 1:end + 1])]


def test_windows_fall_into_fragments_once():
    rng = np.random.default_rng(7)
    sizes = [0, 5, 20, 21, 300, 0, 19, 40]
    ends = np.cumsum(sizes)
    hashes = rng.integers(0, 40, ends[-1]).astype(np.uint64)
    (text, start, n, first), _ = spans.windows_by_anchor(hashes, ends, 20, 8)
    got = [(t, s + k) for t, s, m in zip(text, start, n) for k in range(m)]
    assert sorted(got) == [(t, k) for t, m in enumerate(sizes) for k in range(m - 19)]
    assert len(set(got)) == len(got) and n.max() <= 13
    assert (first - start == np.concatenate([[0], ends])[text]).all()


def test_fragments_do_not_depend_on_repeats(spark):
    """Each fragment has a row, and the words of equal ones are sent once, from the first."""
    rng = random.Random(11)
    draw = lambda n: " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))
    same = draw(60)
    texts = spark.createDataFrame(
        [(i, draw(60) if i % 2 else same, 0) for i in range(40)],
        "doc_id long, text string, key long").repartition(8).cache()
    rows = spans.fragments(texts, 20, 8)
    assert rows.groupBy("doc_id").agg({"n": "sum"}).filter("`sum(n)` = 41").count() == 40
    wanted = rows.filter("doc_id = 0").selectExpr(
        "anchor", "print", "struct(doc_id, key, start) as first")
    sent = spans.fragment_words(texts, wanted, 20, 8, 24)
    assert sent.join(wanted, ["anchor", "print"]).count() == wanted.count()


def test_bit_array_has_no_false_negatives(spark):
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 2 ** 64, 500, dtype=np.uint64)
    rows = spark.createDataFrame([(int(s),) for s in bitfilter.slots(hashes, 20)], "slot long")
    array = bitfilter.collected(rows, 20)
    assert bitfilter.held(array, hashes, 20).all()
    assert bitfilter.held(array, rng.integers(0, 2 ** 64, 5000, dtype=np.uint64), 20).mean() < 0.01
    assert not bitfilter.collected(rows.limit(0), 9).any()
