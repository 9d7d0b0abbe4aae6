"""Stages keep columns whose names are ones that operators use inside."""

import pytest

from duebook.llm import decontaminate, jaccard, lines, simhash, spans, toxicity

NAMES = ["_out_id", "_out_key", "_key", "_id", "_hash", "_lines", "hit_at", "_row", "_known"]
PASSAGE = " ".join(f"word{i}" for i in range(40))
LINE = "a line of text that is long enough"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, PASSAGE), (2, PASSAGE + " more"), (3, f"{LINE}\nx"), (4, f"{LINE}\ny"),
            (5, f"{LINE}\nz"), (6, None), (7, ""), (7, "")]
    return spark.createDataFrame(
        [(i, t, *(f"{n}{i}" for n in NAMES)) for i, t in rows],
        "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))


def check(out, ids):
    got = out.collect()
    assert sorted(r.doc_id for r in got) == ids
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in NAMES)


def test_stages(spark, docs):
    bench = spark.createDataFrame([("a", PASSAGE)], "item_id string, text string")
    check(decontaminate.drop_contaminated(docs, bench), [3, 4, 5, 6, 7, 7])
    check(decontaminate.drop_spans(docs, bench), [1, 2, 3, 4, 5, 6, 7, 7])
    check(jaccard.keep_one(docs), [1, 3, 4, 5, 6])
    check(simhash.keep_one(docs), sorted(
        r.doc_id for r in simhash.keep_one(docs.select("doc_id", "text")).collect()))
    check(lines.dedup_lines(docs), [1, 2, 3, 4, 5, 6, 7, 7])
    check(lines.dedup_lines(docs, broadcast_bytes=0), [1, 2, 3, 4, 5, 6, 7, 7])
    check(spans.dedup_spans(docs, bits=12), [1, 2, 3, 4, 5, 6, 7, 7])
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    check(toxicity.score(docs, labels), [1, 2, 3, 4, 5, 6, 7, 7])
