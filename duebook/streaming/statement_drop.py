"""Statements dropped into a folder, loaded as they arrive.

Exactly-once follows from the load itself: a micro-batch run again finds its
charges already present, and resolves and detects again for its tenants. A late file
simply makes its tenant's results new.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from duebook.operators.skew import materialise
from duebook.plans.ledger import load_files
from duebook.sources import store
from duebook.sources.statements import describe_files

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def load_batch(files: DataFrame, table_root: str) -> None:
    """Load one micro-batch of files into the tables, touching only the buckets
    of the tenants in it. Refused files go to the ``rejects`` table with the reason. The
    paths of a batch (at most ``files_per_batch``) are listed; contents are read in splits."""
    spark = files.sparkSession
    described = materialise(describe_files(files))
    paths = [r[0] for r in described.filter("length > 0").select("source_file").collect()]
    buckets = [r[0] for r in described.filter("user_id is not null").select(
        store.bucket_of().alias("b")).distinct().collect()]
    tables = store.read_tables(spark, table_root, buckets)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    loaded = load_files(tables, described, now, paths)
    loaded.rejects.write.mode("append").parquet(f"{table_root}/rejects")
    if buckets:
        store.write_tables(loaded.tables, table_root, buckets)


def start(spark: SparkSession, drop: str, table_root: str, checkpoint: str,
          files_per_batch: int = 10_000, **trigger) -> StreamingQuery:
    """Watch `drop` (folders as in ``statements.files_under``)."""
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE)
             .option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", files_per_batch).load(drop)
             .select("path", "length", "_metadata.file_path"))
    return (files.writeStream.foreachBatch(lambda df, _: load_batch(df, table_root))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
