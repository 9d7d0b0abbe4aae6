"""Joins and materialisation that hold when one key has a third of the rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
LIST_ROWS = 5_000_000
GROUP_LIMIT = 1000      # spark.sql.optimizer.windowGroupLimitThreshold


def shared_folder(spark) -> str:
    """The cluster's checkpoint folder. In a local session one is made where none is
    named; on a cluster that is an error, as executors would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all of {master} shares")
        named = tempfile.mkdtemp(prefix="duebook-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and go on from there. Cuts
    the lineage, so a lost executor costs a re-read; later readers load only the
    columns they use and know the true size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/duebook-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def per_key_join(big: DataFrame, small: DataFrame, keys: list[str], spread: list[str],
                 how: str = "inner", weight: str | None = None) -> DataFrame:
    """Join `big` to a side with one row per key, without sending all of a hot
    key's rows to one task.

    A key with more than ``HOT_ROWS`` rows is dealt over rows/HOT_ROWS salts by the
    hash of the `spread` columns, and its row of `small` is repeated once per salt;
    all others stay whole. `weight` names a column of `small` that bounds a key's
    rows in `big` from above; without it they are counted. At most total/HOT_ROWS
    keys are hot, so their list is small whatever the data and may be broadcast.
    """
    if weight is None:
        weight = "_rows"
        counted = big.groupBy(*keys).agg(F.count("*").alias(weight)).filter(
            F.col(weight) > HOT_ROWS)
        small = small.join(F.broadcast(counted), keys, "left")
        own = [c for c in small.columns if c != weight]
    else:
        own = small.columns
    salts = F.ceil(F.col(weight) / F.lit(HOT_ROWS)).cast("int")
    hot = small.filter(F.col(weight) > HOT_ROWS).select(*keys, salts.alias("_salts"))
    left = (big.join(F.broadcast(hot), keys, "left")
            .withColumn("_salt", F.when(F.col("_salts").isNotNull(), F.pmod(
                F.xxhash64(*spread), F.col("_salts")).cast("int")).otherwise(0)).drop("_salts"))
    right = small.withColumn("_salt", F.explode(F.when(
        F.col(weight) > HOT_ROWS, F.sequence(F.lit(0), salts - 1)).otherwise(
        F.array(F.lit(0))))).select(*own, "_salt")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


class KeyList(NamedTuple):
    """Distinct keys, written once and counted."""
    rows: DataFrame
    short: bool


def key_list(df: DataFrame | KeyList, keys: list[str]) -> KeyList:
    if isinstance(df, KeyList):
        return df
    rows = materialise(df.select(*keys).distinct())
    return KeyList(rows, rows.count() <= LIST_ROWS)


def join_list(df: DataFrame, listed: DataFrame | KeyList, keys: list[str],
              how: str) -> DataFrame:
    """Semi or anti join with a list of keys. A list counted to be short is
    broadcast, so `df` is not shuffled at all; a longer one joins key by key."""
    listed = key_list(listed, keys)
    if listed.short:
        return df.join(F.broadcast(listed.rows), keys, how)
    return per_key_join(df, listed.rows, keys, [c for c in df.columns if c not in keys], how)


def top_rows(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows per key. Up to n = 1000 Spark cuts to n before the shuffle;
    for more, each key is first cut to n within 64 slices, so that a hot key is
    never sorted in one task."""
    def first(source, by):
        at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return source.withColumn("_rn", at).filter(F.col("_rn") <= n).drop("_rn")

    if n > GROUP_LIMIT:
        slice_of = F.pmod(F.xxhash64(*df.columns), F.lit(64))
        df = first(df.withColumn("_slice", slice_of), [*keys, "_slice"]).drop("_slice")
    return first(df, keys)


def by_python_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partition by `keys` for a Python step, into exactly as many tasks as the
    cluster sets for a shuffle: such steps cost time, not bytes, and would be
    merged into too few tasks by their size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
