"""The pipeline's near-duplicate stage against all pairs: similar texts and those whose
fingerprints are linked."""

import itertools
import random

import corpus_pipeline
from duebook.llm import jaccard, simhash
from test_llm_jaccard import SCHEMA, least_ids, rows
from test_llm_pages import plain_print


def linked_ids(own):
    """Least ids over texts that are similar or whose fingerprints differ in three bits at most."""
    prints, least = [plain_print(t) for _, t, _ in own], least_ids(own)
    for (i, x), (j, y) in itertools.combinations(enumerate(prints), 2):
        if (x ^ y).bit_count() <= 3 and least[i] != least[j]:
            a, b = sorted((least[i], least[j]))
            least = {k: a if v == b else v for k, v in least.items()}
    return least


def test_stage_keeps_the_links_of_fingerprints(spark):
    """Texts that repeat themselves: within three bits, but their distinct shingles differ."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(3000)]
    own = [t for _, t, _ in rows()]
    for _ in range(6):
        often = " ".join([" ".join(rng.sample(words, 9))] * 50)
        own += [f"{often} " + " ".join(rng.sample(words, 10)) for _ in range(3)]
    own += [f"dear customer your order has been shipped number {i}" for i in range(60)]
    rng.shuffle(own)
    own = [(i, t, "x") for i, t in enumerate(own)]
    docs = spark.createDataFrame(own, SCHEMA)
    want = linked_ids(own)
    similar = set(least_ids(own).values())
    assert len(set(want.values())) <= len(similar) - 12
    kept = {r.doc_id for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()}
    assert kept == set(want.values())
    assert kept <= {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert {r.doc_id for r in jaccard.keep_one(docs).collect()} == similar


def test_copies_without_an_id_of_their_own_go(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "wv")
    docs = spark.createDataFrame(
        [(None, text, "x"), (None, text, "x"), (None, f"{text} more", "x"), (None, "alone", "x"),
         (7, other, "x"), (7, f"{other} more", "x"), (7, f"{other} more", "x"), (None, other, "x"),
         (8, "by itself", "x")], SCHEMA)
    kept = corpus_pipeline.dedup_documents(spark, docs, "").collect()
    assert sorted((r.doc_id or -1, r.text.split()[0]) for r in kept) == [
        (-1, "alone"), (-1, "w0"), (7, "v0"), (8, "by")]
    kept = simhash.keep_one(docs).filter("text like 'w0%' or text = 'alone'")
    assert kept.filter("text = 'alone'").count() == 1
    assert kept.groupBy("text").count().filter("count > 1").isEmpty()


def test_trees_give_linked_pairs_only(spark):
    rng, prints = random.Random(9), set()
    for _ in range(20):
        x = rng.getrandbits(63)
        for _ in range(12):
            prints.add(x)
            x ^= sum(1 << b for b in rng.sample(range(63), rng.randrange(1, 4)))
    distinct = spark.createDataFrame([(x,) for x in prints], "fingerprint long")
    found = simhash.links(distinct).collect()
    assert all((r.a ^ r.b).bit_count() <= 3 for r in found)
    assert len(found) == 220 and len({frozenset(r) for r in found}) == 220
