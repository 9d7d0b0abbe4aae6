"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duebook.llm import (collocations, decontaminate, extract, lines, neighbours, packing,
                         resample, scoring, simhash, spans, toxicity, warc, whitening)
from duebook.llm.common import read
from duebook.operators.skew import shared_folder


def op1_extract(spark, d):
    return extract.extract(read(spark, d, "pages", "page_id", "url", "html"))


def op2_resample(spark, d):
    """The rows drawn; the target are the rows labelled as of good quality."""
    good = read(spark, d, "labels", "doc_id", "quality").filter("quality = 1")
    return resample.resample(read(spark, d, "documents", "doc_id", "text"), good)


def op3_neighbours(spark, d):
    return neighbours.nearest(read(spark, d, "embeddings", "vec_id", "embedding"),
                              F.col("vec_id") % 20 == 0)


def op4_scoring(spark, d):
    return scoring.score(read(spark, d, "documents", "doc_id", "text"))


def op5_decontaminate(spark, d):
    found = decontaminate.contamination(read(spark, d, "documents", "doc_id", "text"),
                                        read(spark, d, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        "contaminated")


def op6_warc(spark, d):
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(read(spark, d, "pages", "page_id", "url", "html"), path)
    pages = warc.read_archives(spark, path)
    return pages.select("page_id", "payload_bytes", F.coalesce(
        F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", "refers_to")


def op7_simhash(spark, d):
    return simhash.near_duplicates(read(spark, d, "documents", "doc_id", "text")).select(
        "doc_id", "fingerprint", "component_id")


def op8_packing(spark, d):
    cut = packing.pieces(read(spark, d, "documents", "doc_id", "text"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32",
                                    "sequence_id", "offset")


def op9_toxicity(spark, d):
    found = toxicity.score(read(spark, d, "documents", "doc_id", "text"),
                           read(spark, d, "labels", "doc_id", "toxic"))
    return found.select("doc_id", "held_out", "score", "predicted", "evidence")


def op10_lines(spark, d):
    kept = lines.dedup_lines(read(spark, d, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(
        F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op11_whitening(spark, d):
    return whitening.whiten(read(spark, d, "embeddings", "vec_id", "embedding"))


def op12_spans(spark, d):
    kept = spans.dedup_spans(read(spark, d, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(
        F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op13_collocations(spark, d):
    return collocations.collocations(read(spark, d, "documents", "text", "lang"))


QUERIES = {f.__name__: f for f in (
    op1_extract, op2_resample, op3_neighbours, op4_scoring, op5_decontaminate, op6_warc,
    op7_simhash, op8_packing, op9_toxicity, op10_lines, op11_whitening, op12_spans,
    op13_collocations)}
