"""Near-duplicates by shingles against all pairs."""

import random

import corpus_pipeline
from duebook.llm import jaccard, simhash

SCHEMA = "doc_id long, text string, lang string"


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 160))]
        if rng.random() < 0.5:
            base += passage
        out.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(1, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    base = [rng.choice(words) for _ in range(90)]
    for i in range(60):                 # one large group
        copy = list(base)
        copy[i] = "x"
        out.append(" ".join(copy))
    out += [out[0], out[0].upper(), "one two", "One  two", "", None, "  "]
    rng.shuffle(out)
    return [(i, t, "x") for i, t in enumerate(out)]


def least_ids(own):
    sets = {i: shingle_set(t) for i, t, _ in own}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_pipeline_stage_keeps_one_of_each_group_at_four_fifths(spark):
    own = rows()
    docs = spark.createDataFrame(own, SCHEMA)
    want = least_ids(own)
    found = jaccard.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    kept = corpus_pipeline.dedup_documents(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.keep_one(docs).count() != len(set(want.values()))
    assert corpus_pipeline.dedup_documents(spark, docs.limit(0), "").count() == 0


def test_rows_without_id(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text, "x"), (None, "alone", "x"), (7, text, "x"),
                                  (7, text, "x")], SCHEMA)
    kept = jaccard.keep_one(docs).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "alone"), (7, text)]


def test_texts_of_one_template_are_not_paired(spark, monkeypatch):
    """Below the similarity; the pairs that are verified grow with the texts, not their square."""
    seen = []
    real = jaccard.verified

    def counted(pairs, *more):
        seen.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(jaccard, "verified", counted)
    n = 600
    own = [(i, f"dear customer your order has been shipped number {i}", "x") for i in range(n)]
    own += [(n + i, f"w{i} " + " ".join(f"v{k}" for k in range(30)), "x") for i in range(3)]
    found = jaccard.near_duplicates(spark.createDataFrame(own, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in found} == least_ids(own)
    assert sum(seen) < 4 * n


def test_stage_asks_the_trees_and_checks_their_links(spark, monkeypatch):
    """The trees' links are verified before the index looks for others; wrong ones fall, and
    those that the trees miss are found."""
    own = rows()
    docs = spark.createDataFrame(own, SCHEMA)
    want, real, pairs = sorted(set(least_ids(own).values())), simhash.links, jaccard.verified
    seen = []

    def counted(asked, *more):
        found = pairs(asked, *more)
        seen.append((asked.count(), found.count()))
        return found

    def kept():
        return sorted(r.doc_id for r in corpus_pipeline.dedup_documents(
            spark, docs, "").collect())

    def chained(distinct, *more):
        row = distinct.selectExpr("min(fingerprint) as b")
        return distinct.crossJoin(row).selectExpr("fingerprint as a", "b")

    monkeypatch.setattr(jaccard, "verified", counted)
    given = []
    monkeypatch.setattr(simhash, "links", lambda d, *more: given.append(d) or real(d, *more))
    assert kept() == want
    assert len(given) == 1 and len(seen) == 3 and seen[0][1] > 20
    monkeypatch.setattr(simhash, "links", chained)
    assert kept() == want
    monkeypatch.setattr(simhash, "links", lambda d, *more: real(d, *more).limit(0))
    assert kept() == want


def test_only_shingles_of_several_sets_are_written(spark, monkeypatch):
    written, real = [], jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df: written.append(real(df)) or written[-1])
    jaccard.near_duplicates(spark.createDataFrame(rows(), SCHEMA))
    index = [df for df in written if {"shingle", "set_key"} <= set(df.columns)]
    assert index
    for df in index[:1]:
        sets = df.selectExpr("shingle", "set_key").distinct().groupBy("shingle").count()
        assert sets.count() and sets.filter("count < 2").isEmpty()
