"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from duebook.llm import collocations

SCHEMA = "text string, lang string, phrase long, n string, head string"


def plain(rows, least, top, most=4, scale=2_000_000, cover=80):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for size in range(1, most + 1):
                for k in range(len(words) - size + 1):
                    counts[lang][tuple(words[k:k + size])] += 1
    out = []
    for lang, c in counts.items():
        good = {p: f for p, f in c.items() if len(p) > 1 and f >= least}
        gone = set()
        for p, f in good.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    if 100 * f >= cover * c[p[k:k + size]]:
                        gone.add(p[k:k + size])
        rated = []
        for p, a in good.items():
            if p not in gone:
                score, k = min((scale * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, totals[lang], -s)
                for i, (s, a, p, x, y) in enumerate(sorted(rated)[:top], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["New", "york", "of", "the", "état", "Ö", "x y", "it's"] + [f"w{i}" for i in range(9)]
    fixed = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 7))) for _ in range(8)]
    rows = []
    for _ in range(300):
        text = "".join((rng.choice(fixed) if rng.random() < 0.5 else rng.choice(words))
                       + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ! "]) for _ in range(20))
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" .;\n", "fr"), ("solo", "xx"), rows[0], rows[0],
                   ("again " * 20_000, "en"), (" ".join(words) * 400, "long")]


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in collocations.collocations(df, **how).collect())


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"bits": 9, "top": 7}), (3, {"most": 3})])
def test_equals_plain_counts(spark, seed, how):
    rows = corpus(seed)
    want = plain(rows, 30, how.get("top", 2000), how.get("most", 4))
    assert len(want) > 20 and run(spark, rows, **how) == want


def test_streams_meet_their_parts_when_a_word_is_hot(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "text string, lang string")
    totals, stream = collocations.count_streams(df, 4, 10, 20)
    whole = collocations.scored(stream, totals, 2_000_000, 80)
    dealt = collocations.scored(stream, totals, 2_000_000, 80, hot=3)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, dealt.collect()))
    known = {(r.lang, r.phrase): r.n for r in stream.collect()}
    for backwards in (False, True):
        for r in collocations.merged(stream, backwards, hot=3).collect():
            words = r.phrase.split(" ")
            parts = [words[-k:] if backwards else words[:k] for k in range(1, len(words))]
            assert r.parts == [known[r.lang, " ".join(p)] for p in parts]


def test_counts_beyond_64_bits(spark):
    n = 6 * 10 ** 12
    stream = spark.createDataFrame([("en", "a", n, 1), ("en", "b", n + 1, 1), ("en", "a b", n, 2)],
                                   "lang string, phrase string, n long, size int")
    totals = spark.createDataFrame([("en", 3 * n)], "lang string, total long")
    row = collocations.scored(stream, totals, 2_000_000, 80).first()
    assert row.score == 2_000_000 * n // (2 * n + 1)


def test_nothing_frequent(spark):
    for rows in ([], [("a b c", "en")], [(None, None)]):
        df = spark.createDataFrame(rows, "text string, lang string")
        assert collocations.collocations(df).count() == 0
