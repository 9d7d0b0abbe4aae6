"""The two conflict clauses of the data model, as joins over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by `order`. A min-by aggregate, so it combines
    before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def merge_keep_first(old: DataFrame, new: DataFrame, keys: list[str],
                     order: list[str] | None = None) -> DataFrame:
    """Insert, on conflict do nothing: rows of `new` whose key is unknown join
    `old`; of equal keys within `new` the first by `order` counts."""
    new = first_per_key(new, keys, order) if order else new.dropDuplicates(keys)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def merge_update(old: DataFrame, new: DataFrame, keys: list[str],
                 update: list[str]) -> DataFrame:
    """Insert, on conflict overwrite the `update` columns (NULLs included) and
    leave the rest. `new` must have one row per key."""
    o = old.select(*keys, F.struct(*old.columns).alias("_old"))
    n = new.select(*keys, F.struct(*new.columns).alias("_new"))
    joined = o.join(n, keys, "full_outer")
    columns = []
    for c in old.columns:
        if c in keys:
            columns.append(F.col(c))
        elif c in update:
            columns.append(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}"))
                           .otherwise(F.col(f"_old.{c}")).alias(c))
        else:
            columns.append(F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}"))
                           .otherwise(F.col(f"_new.{c}")).alias(c))
    return joined.select(*columns)
