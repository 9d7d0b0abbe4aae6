"""What Python workers hold: batches of bounded size, and nothing that outlives a task; what
the driver holds and plans."""

import gc

import pyarrow as pa
from pyspark.sql import functions as F

from duebook.llm import common, packing, toxicity


def test_texts_come_in_batches_of_bounded_size(spark):
    docs = spark.range(6000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    packing.pieces(docs)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 30_000_000 and max(found) <= 10_000_000


def test_a_worker_forgets_pretokens_after_its_task(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.lit("some"), F.col("id").cast("string")).alias("text"))
    assert packing.pieces(docs).count() == 400

    def held(batches):
        from duebook.llm import packing
        for _ in batches:
            pass
        n = sum(len(e.table) + len(e.older) for e in packing.ENCODERS.values())
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    found = spark.range(64).repartition(16).mapInArrow(held, "n long").collect()
    assert {r["n"] for r in found} == {0}


def test_ids_stay_right_when_tables_pass_on(monkeypatch):
    texts = [f"Wörter {i} and {i % 7} it's, {'x' * (i % 50)}  end\n" for i in range(900)] * 2
    encoder = packing.Encoder(packing.default_tokenizer())
    whole = [encoder.whole(t) for t in texts]
    monkeypatch.setattr(packing, "TABLE", 60)
    monkeypatch.setattr(packing, "CHUNK", 300)
    assert list(encoder.encode(texts)) == whole
    assert len(encoder.table) <= 200 and encoder.older


def test_terms_hashed_in_slices_are_found_alike(monkeypatch):
    terms = sorted({f"t{chr(97 + i % 26)}{'o' * (i % 9)}{chr(97 + i // 26)}".encode()
                    for i in range(500)})
    texts = [b" ".join(terms[i::7]) for i in range(7)] + [b"unknown", b""]
    weights = [1.0 + i for i in range(len(terms))]
    monkeypatch.setattr(toxicity, "TERMS", 10 ** 6)
    one = toxicity.Vectors(terms, toxicity.np.array(weights)).occurrences(texts)
    monkeypatch.setattr(toxicity, "TERMS", 37)
    many = toxicity.Vectors(terms, toxicity.np.array(weights)).occurrences(texts)
    assert all((a == b).all() for a, b in zip(one, many))


def test_edges_that_are_stars_take_no_round(spark, monkeypatch):
    written, real = [], common.materialise

    def counted(df):
        written.append(real(df))
        return written[-1]

    monkeypatch.setattr(common, "materialise", counted)

    def found(edges):
        written.clear()
        rows = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
        return {r["node"]: r["root"] for r in rows}

    stars = [(i, i % 7) for i in range(7, 200)] + [(3, 3)]
    assert found(stars) == {**{i: i % 7 for i in range(200)}}
    assert len(written) == 1
    assert found([*stars, (150, 151)]) == {i: 3 if i % 7 in (3, 4) else i % 7 for i in range(200)}
    assert len(written) <= 3


def test_the_driver_gives_back_the_model_once_it_is_sent(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(
        " ", F.lit("some"), F.when(F.col("id") % 2 == 0, "bad").otherwise("good")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    held = []

    def noted():
        gc.collect()
        held.append(sum(isinstance(x, toxicity.Model) for x in gc.get_objects()))

    monkeypatch.setattr(toxicity, "give_back", noted)
    toxicity.score(docs, labels)
    assert held and held[-1] == 0
