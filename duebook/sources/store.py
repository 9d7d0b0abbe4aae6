"""The tables on shared storage: parquet, split by a bucket of the tenant, published as
snapshots.

A load writes the buckets of its tenants, and nothing else, as files of a version of its
own; nothing that readers see changes. Then one small manifest is put in place that names
the version to read of every table and bucket. It comes last and appears at once, so a
reader sees all tables of a load or none of it, and a load that breaks off between two
tables leaves only files that no manifest names. ``drop_versions`` removes those.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.sources import schemas

BUCKETS = 64           # of a new store; more tenants and more cores want more
BUCKET = "tenant_bucket"
SNAPSHOTS = "_snapshots"
SCHEMAS = {
    "account": schemas.ACCOUNT, "merchant": schemas.MERCHANT,
    "merchant_alias": schemas.MERCHANT_ALIAS, "raw_transaction": schemas.TRANSACTION,
    "resolution_queue": schemas.RESOLUTION_QUEUE, "subscription": schemas.SUBSCRIPTION,
    "price_change": schemas.PRICE_CHANGE,
}


def bucket_of():
    return F.pmod(F.xxhash64("user_id"), F.lit(BUCKETS)).cast("int")


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], s) for name, s in SCHEMAS.items()}


# --------------------------------------------------------------- manifests --
class Folder:
    """A folder of the store's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.fs.exists(self.at()):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at()))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that is either there as a whole or not at all."""
        draft = f".{uuid.uuid4().hex}"
        stream = self.fs.create(self.at(draft))
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self.at(name)) or not self.fs.rename(self.at(draft), self.at(name)):
            raise RuntimeError(f"{name} of {self.path} was published by another load")

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests, oldest first."""
    names = Folder(spark, f"{root}/{SNAPSHOTS}").names()
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))


def manifest(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """table -> bucket -> version, of one snapshot or the newest."""
    known = snapshots(spark, root)
    number = known[-1] if number is None and known else number
    if number is None:
        return {name: {} for name in SCHEMAS}
    text = Folder(spark, f"{root}/{SNAPSHOTS}").read(f"{number:010d}.json")
    return {name: {int(b): v for b, v in versions.items()}
            for name, versions in json.loads(text).items()}


# ------------------------------------------------------------------ tables --
def read_tables(spark: SparkSession, root: str, buckets: list[int] | None = None,
                snapshot: int | None = None) -> dict[str, DataFrame]:
    """All tables of a snapshot (the newest, if none is named), or only some buckets of
    them; other buckets' files are not even listed."""
    tables = {}
    for name, versions in manifest(spark, root, snapshot).items():
        paths = [f"{root}/{name}/{version}/{BUCKET}={bucket}"
                 for bucket, version in sorted(versions.items())
                 if buckets is None or bucket in buckets]
        df = (spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths
              else spark.createDataFrame([], SCHEMAS[name]))
        tables[name] = df.filter("user_id is not null")
    return tables


def write_tables(tables: dict[str, DataFrame], root: str, buckets: list[int]) -> None:
    """Replace the given buckets (at most 64 numbers) in a new snapshot. A placeholder row
    without a tenant goes into each bucket, so that one that became empty is there too."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    newest = snapshots(spark, root)
    versions = manifest(spark, root)
    for name, df in tables.items():
        blank = spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} int")
        (df.withColumn(BUCKET, bucket_of()).filter(F.col(BUCKET).isin(buckets))
         .unionByName(blank, allowMissingColumns=True)
         .hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "user_id")
         .write.partitionBy(BUCKET).parquet(f"{root}/{name}/{version}"))
        versions[name] |= {b: version for b in buckets}
    number = (newest[-1] if newest else 0) + 1
    Folder(spark, f"{root}/{SNAPSHOTS}").publish(f"{number:010d}.json", json.dumps(versions))


def drop_versions(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Remove all but the newest `keep` snapshots, and the files that none of these names.
    Not while a load runs: its files are not named yet."""
    known = snapshots(spark, root)
    held = [manifest(spark, root, n) for n in known[-keep:]]
    for number in known[:-keep]:
        Folder(spark, f"{root}/{SNAPSHOTS}").drop(f"{number:010d}.json")
    for name in SCHEMAS:
        folder = Folder(spark, f"{root}/{name}")
        for version in folder.names():
            used = {b for m in held for b, v in m[name].items() if v == version}
            inner = Folder(spark, f"{root}/{name}/{version}")
            for part in inner.names():
                bucket = re.fullmatch(rf"{BUCKET}=(\d+)", part)
                if bucket and int(bucket[1]) not in used:
                    inner.drop(part)
            if not used:
                folder.drop(version)
