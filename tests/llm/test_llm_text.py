"""Operators on texts against brute force: scoring, decontamination, line dedup, toxicity,
resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from duebook.llm import decontaminate, lines, resample, scoring, toxicity
from duebook.llm.common import components

SCHEMA = "doc_id long, text string, lang string"
WORDS = [a + b for a in ("ka", "lo", "mi", "te", "ru", "é", "Str") for b in ("n", "rd", "x", "p,")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, equal rows, a long text."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    return [(900, None, "x"), (901, "", "x"), (902, " \n\t ", "x"), (None, "lo mi", "x"),
            (903, "same row", "x"), (903, "same row", "x"), (904, long, None)]


# --------------------------------------------------------------- components --
def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ scoring --
def plain_base(rows):
    counts = Counter()
    for doc_id, text, _ in rows:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counts.update((text or "").encode().lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text, _ in rows:
        words = (text or "").encode().lower().split() + [b""]
        out.append((doc_id, len(words), sum(counts[w] > 0 for w in words), n, sum(
            math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(60)), "en") for i in range(150)] + odd_rows()
    docs = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", n_tokens string")
    return rows, scoring.score(docs).collect()


def test_base_scores(scored):
    rows, found = scored
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 6))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
                  for r in found), key=key)
    want = sorted(plain_base(rows), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
               for r in found)


def test_scores_are_probabilities_and_learn(scored):
    _, found = scored
    assert all(r.score < 0 and math.isfinite(r.bits_per_byte) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > 1.01 * sum(r.base_score for r in held)


def test_rare_words_join_the_base(spark, monkeypatch):
    monkeypatch.setattr(scoring, "frequent_words", lambda words, limit=0, f=scoring.frequent_words:
                        f(words, 5))
    rng = random.Random(6)
    rows = [(i, sentence(rng, 30), "en") for i in range(40)]
    got = {r.doc_id: r for r in scoring.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc_id, n, known, total, base in plain_base(rows):
        r = got[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-6


def test_tree_of_words_sums_to_one():
    paths = scoring.huffman(np.array([5.0, 1, 1, 9, 30, 2]))
    assert abs(sum(2.0 ** -paths.length) - 1) < 1e-12
    for symbol in range(6):
        own = slice(paths.start[symbol], paths.start[symbol] + paths.length[symbol])
        assert paths.node[own][0] == 0
    assert len(scoring.huffman(np.array([1.0])).node) == 0


def model_of(texts):
    counts = Counter(w for t in texts for w in t.lower().split() + [b""])
    top = counts.most_common(10)
    known = scoring.Known(b"\n".join(w for w, _ in top), np.log10(np.array([0] + [
        n for _, n in top]) + 1.0), np.array([0] + [scoring.high_of(w) for w, _ in top], np.uint8),
        scoring.huffman(np.array([3.0] + [n for _, n in top])))
    rng = np.random.default_rng(0)
    return scoring.Model(known, scoring.byte_paths(rng.random((256, 256))),
                         rng.normal(size=(2, 1 << scoring.WORD_BITS)).astype(np.float32),
                         rng.normal(size=(3, 1 << scoring.SPELL_BITS)).astype(np.float32))


def test_next_word_probabilities_sum_to_one():
    """After one text, the chances of all words of the tree, and of spelling another."""
    model = model_of([b"aa bb cc dd ee aa bb", b"aa"])
    numbers = model.known.numbers()
    start = b"aa zz bb"

    def log(words):
        t = scoring.tokens_of([words], numbers, model.known)
        t = t._replace(cuts=np.array([0, len(t.number) - 1]))      # without the end
        return scoring.text_logs(t, model)[0]

    whole = log(start)
    total = sum(math.exp(log(start + b" " + w) - whole) for w in numbers if w)
    t = scoring.tokens_of([start], numbers, model.known)
    total += math.exp(scoring.text_logs(t, model)[0] - whole)      # the end
    assert 0 < total < 1


def test_score_does_not_depend_on_company():
    rng = random.Random(8)
    texts = [sentence(rng, n).encode() for n in (3, 700, 40, 1, 0, 2000)]
    model = model_of(texts)
    numbers = model.known.numbers()
    both = scoring.text_logs(scoring.tokens_of(texts, numbers, model.known), model)
    alone = [scoring.text_logs(scoring.tokens_of([t], numbers, model.known), model)[0]
             for t in texts]
    assert np.allclose(both, alone, rtol=1e-4)


def test_segments_of_about_one_length_are_stepped_together(monkeypatch):
    rng = random.Random(9)
    texts = [sentence(rng, rng.choice((2, 60, 300))).encode() for _ in range(200)]
    model, groups = model_of(texts), []
    t = scoring.tokens_of(texts, model.known.numbers(), model.known)
    whole = scoring.text_logs(t, model)
    mixed_logs = scoring.mixed_logs
    monkeypatch.setattr(scoring, "STEPPED", 1000)
    monkeypatch.setattr(scoring, "mixed_logs", lambda t, a, b, model: (
        groups.append(b - a), mixed_logs(t, a, b, model))[1])
    assert np.allclose(scoring.text_logs(t, model), whole, rtol=1e-4)
    assert sum(g.sum() for g in groups) == len(t.number)
    assert max(g.sum() for g in groups) <= 1000 + scoring.SEGMENT
    assert all(a.min() >= b.max() for a, b in zip(groups, groups[1:]))


def test_equal_words_are_counted_together():
    rng = random.Random(10)
    texts = [sentence(rng, 400).encode(), b"", " é  \xa0 x ".encode()]
    model = model_of(texts)
    t = scoring.tokens_of(texts, model.known.numbers(), model.known)
    assert t.sizes.tolist() == [sum(len(w) + 1 for w in x.lower().split()) + 1 for x in texts]
    for k, context in enumerate((t.kind, t.before)):
        got, want = np.zeros((2, 2 << scoring.WORD_BITS), dtype=np.float32)
        scoring.count_into(got, t.number, context, model.known.paths)
        steps = scoring.word_steps(t.number, t.kind, t.before, model.known.paths)
        np.add.at(want, steps.slot(k) * 2 + steps.bit, np.float32(1))
        assert (got == want).all() and got.sum() == len(steps.bit)


def test_scoring_nothing(spark):
    assert scoring.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = scoring.score(spark.createDataFrame([(i, "lo mi", "x") for i in held], SCHEMA)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in got] == [(0, 0, 0.0)] * 3


# --------------------------------------------------------- decontamination --
def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        own = words_of(item)
        n = min(13, len(own))
        grams = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1) if grams else ():
            if tuple(words[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(
        ",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def contaminated_rows():
    rng = random.Random(11)
    items = [(i, sentence(rng, rng.randrange(14, 40))) for i in range(12)]
    items += [(50, "short ITEM"), (51, ""), (52, None), (53, items[0][1]), (54, "ÉTÉ x")]
    rows = []
    for i in range(60):
        text = sentence(rng, rng.randrange(0, 300))
        if i % 4 == 0:
            own = items[i % 12][1].upper().replace("É", "é").split()
            at = rng.randrange(len(own))
            text += "... " + " -- ".join(own[at:at + rng.randrange(10, 20)]) + "; " + text
        rows.append((i, text + (" Short item" if i % 9 == 0 else ""), "x"))
    return rows + odd_rows() + [(905, "ÉTÉ x", "x"), (906, "été x", "x")], items


@pytest.mark.parametrize("limit", [100_000, 3])
def test_contamination(spark, limit):
    rows, items = contaminated_rows()
    docs = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, limit=limit).collect()
    mine = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(
        ",".join(r["items"]).encode()).hexdigest(), r.contaminated) for r in got)
    assert mine == Counter((i, *plain_hits(t, items)) for i, t, _ in rows)


def test_spans_and_documents_go(spark):
    rows, items = contaminated_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench).collect()
    assert Counter(map(tuple, kept)) == Counter(
        r for r in rows if not plain_hits(r[1], items)[4])
    cut = decontaminate.drop_spans(docs, bench).collect()
    assert len(cut) == len(rows)
    before = {(r[0]): plain_hits(r[1], items) for r in rows}
    for r in cut:
        n_words, n_hit = before[r.doc_id][:2]
        assert len(words_of(r.text)) == n_words - n_hit
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, empty).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# -------------------------------------------------------------------- lines --
def plain_lines(rows):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    holders = {}
    for doc_id, text, _ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(lines.NO_ID if doc_id is None else doc_id)
    out = []
    for doc_id, text, _ in rows:
        own = (text or "").split("\n")
        me = lines.NO_ID if doc_id is None else doc_id
        kept = [x for x in own if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == me]
        out.append((doc_id, len(own), len(own) - len(kept), None if text is None
                    else "\n".join(kept)))
    return Counter(out)


def shared_line_rows():
    rng = random.Random(12)
    shared = [sentence(rng, 6) + "é" * k for k in range(8)]
    rows = []
    for i in range(80):
        own = [rng.choice(shared) if rng.random() < 0.4 else sentence(rng, rng.randrange(9))
               for _ in range(rng.randrange(1, 7))]
        own = [x.upper().replace("É", "é") + "\t " if rng.random() < 0.2 else x for x in own]
        rows.append((i, "\n".join(own), "x"))
    rows += odd_rows() + [(None, shared[0] + "\n" + shared[1], "x"), (77, shared[0], "y"),
                          (950, "é" * 19, "x"), (951, "é" * 19, "x"), (952, "é" * 19, "x")]
    return rows


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, 0])
def test_line_dedup(spark, limit, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 3)
    monkeypatch.setattr(lines, "PROBES", 40)
    rows = shared_line_rows()
    docs = spark.createDataFrame([(*r, 5, 7) for r in rows], SCHEMA + ", n_chars int, N_lines int")
    got = lines.dedup_lines(docs, broadcast_bytes=limit).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == plain_lines(rows)
    assert all(r.n_chars == (5 if r.text is None else len(r.text)) for r in got)
    assert lines.dedup_lines(docs.limit(0), broadcast_bytes=limit).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2 ** 64, 5000, dtype=np.uint64) for _ in range(2))
    a[1:20] = a[0]
    index = lines.PerfectHash.of(a, b)
    assert sorted(index.numbers(a, b).tolist()) == list(range(5000))
    shard = lines.Shard(lines.shard_row(0, a, b, np.full(5000, 3), np.arange(5000)))
    known, keeper = shard.keeper(a, b, 3)
    assert known.all() and (keeper == np.arange(5000)).all()
    assert not shard.keeper(a, b ^ np.uint64(1), 3)[0].any()
    assert not shard.keeper(a, b, 4)[0].any()
    with pytest.raises(ValueError):
        lines.PerfectHash.of(a[[0, 0]], b[[0, 0]])


# ----------------------------------------------------------------- toxicity --
def toxic_rows(n=400):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        text = sentence(rng, rng.randrange(5, 60))
        if toxic:
            text += " " + " ".join(rng.choice(["Dolt!", "oaf", "cad?"]) for _ in range(3))
        rows.append((i, text, "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(*r, "own") for r in rows + odd_rows()], SCHEMA + ", Score string")
    marks = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, marks).collect()
    assert len(got) == len(rows) + 7
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(not r.predicted for r in got if r.doc_id is None or r.doc_id >= 900)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
               for r in got)
    assert any(r.evidence for r in held)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not r.predicted for r in got)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = toxic_rows(150)
    docs = spark.createDataFrame(rows, SCHEMA)
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(
        docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())
        for x in (labels, [(i, 1 - y if i in held else y) for i, y in labels]))
    assert a == b


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), none).count() == 0
    clean = spark.createDataFrame([(903, 0), (904, 0)], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score(docs, clean).collect())


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    rows = toxicity.unit(rng.random((700, 40)) * (rng.random((700, 40)) < 0.15))
    rows[5] = rows[9]
    rows = rows[rows.any(1)]
    asked = toxicity.unit(rng.random((90, 40)) * (rng.random((90, 40)) < 0.1))
    asked[0] = 0
    asked[1] = rows[5]
    found = toxicity.BlockMaxIndex(rows).nearest(asked, 7)
    cosine = np.round(asked @ rows.T, 12)
    order = np.lexsort((np.tile(np.arange(len(rows)), (90, 1)), -cosine), axis=1)[:, :7]
    want = np.take_along_axis(cosine, order, 1)
    assert np.allclose(np.where(want > 0, want, -1), found.cosine)
    assert (np.where(want > 0, order, -1) == np.where(want > 0, found.example, -1)).all()
    assert toxicity.BlockMaxIndex(np.zeros((0, 40))).nearest(asked, 7).cosine.shape == (90, 0)


# --------------------------------------------------------------- resampling --
def test_resampling_prefers_the_target(spark):
    rng = random.Random(14)
    rows = [(i, sentence(rng, 40), "x") for i in range(100)]
    rows += [(100 + i, "zz %%% zz qq %%% " * 12, "x") for i in range(30)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows + odd_rows()],
                                 SCHEMA + ", log_weight double")
    target = spark.createDataFrame([(i,) for i in range(0, 100, 2)], "doc_id long")
    got = resample.resample(docs, target, 0.7).collect()
    assert len(got) == math.ceil(0.7 * 137)
    assert sum(100 <= (r.doc_id or 0) < 130 for r in got) == 0
    again = resample.resample(docs.repartition(5), target, 0.7).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in again)
    assert resample.resample(docs.limit(0), target).count() == 0
    assert resample.resample(docs, target.limit(0), 1.0).count() == 137


def test_log_weights(spark):
    ratios = np.random.default_rng(1).normal(size=resample.BUCKETS)
    rows = spark.createDataFrame([(1, "A b  a", "x"), (2, None, "x")], SCHEMA)
    got = {r.doc_id: r for r in resample.log_weights(rows, ratios).collect()}
    assert got[2].n_grams == 0 and got[2].log_weight == 0
    own = resample.buckets_of(b"a b a")
    assert got[1].n_grams == 5 and abs(got[1].log_weight - ratios[own].sum()) < 1e-9
    assert own[0] == own[2] != own[1]


def test_largest_by_histograms(spark, monkeypatch):
    monkeypatch.setattr(resample, "TAIL", 5)
    monkeypatch.setattr(resample, "BINS", 4)
    rng = random.Random(15)
    values = [(i, round(rng.gauss(0, 100) ** 3, 2)) for i in range(300)] + [
        (i, 7.0) for i in range(300, 340)]
    rows = spark.createDataFrame(values, "doc_id long, key double")
    for k in (0, 1, 17, 150, 339, 340, 500):
        got = sorted(r.doc_id for r in resample.largest(rows, k, "key").collect())
        assert got == sorted(i for i, _ in sorted(values, key=lambda x: (-x[1], x[0]))[:k])
