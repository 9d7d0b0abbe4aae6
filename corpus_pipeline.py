"""Cleaning and packing a corpus: each stage works on all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from duebook.llm import decontaminate, jaccard, lines, packing, toxicity
from duebook.llm.common import materialise, read


def same_columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[f"`{c}`" for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the one with the largest id."""
    return same_columns(lines.dedup_lines(docs), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints, as in query op7, or by a similarity of 0.8 or
    more (sets of five-word shingles) the smallest id stays."""
    return same_columns(jaccard.keep_one(docs, prints=True), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    benchmark = read(spark, sf_dir, "benchmark", "item_id", "text")
    return same_columns(decontaminate.drop_contaminated(docs, benchmark), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as token sequences: a row for each piece, as in query op8."""
    return packing.pack(packing.pieces(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines),
          ("simhash_near_dedup", dedup_documents), ("benchmark_decontamination", drop_contaminated),
          ("best_fit_packing", pack)]

#: Neither the votes of nearest examples nor a tokenizer can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
