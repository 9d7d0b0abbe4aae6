"""Tenant scope and whole-tenant maintenance of the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.operators.series import SERIES
from duebook.operators.skew import KeyList, join_list, key_list
from duebook.sources.schemas import EXPORT_TABLES


def for_tenant(df: DataFrame, user_id: int | None) -> DataFrame:
    """One tenant's rows; empty if there is no tenant."""
    return df.filter(F.col("user_id") == F.lit(user_id).cast("bigint"))


def without_tenants(df: DataFrame, users: DataFrame | KeyList) -> DataFrame:
    """Rows of everyone but `users`."""
    return join_list(df, users, ["user_id"], "left_anti")


def only_tenants(df: DataFrame, users: DataFrame | KeyList) -> DataFrame:
    return join_list(df, users, ["user_id"], "left_semi")


def erase(tables: dict[str, DataFrame], users: DataFrame) -> dict[str, DataFrame]:
    """Every table without the given users."""
    users = key_list(users, ["user_id"])
    return {name: without_tenants(df, users) for name, df in tables.items()}


def replace_derived(old: DataFrame, new: DataFrame, affected: DataFrame | KeyList) -> DataFrame:
    """Swap the derived rows of the affected tenants and keep everyone else's."""
    return without_tenants(old, affected).unionByName(new)


def purge_expired(df: DataFrame, expires: str, now: dt.datetime) -> DataFrame:
    """Drop rows past their expiry."""
    return df.filter(F.col(expires) >= F.lit(now))


def purge_older(df: DataFrame, at: str, now: dt.datetime, hours: int = 24) -> DataFrame:
    """Drop rows older than `hours` (a day covers every limit window)."""
    return df.filter(F.col(at) >= F.lit(now - dt.timedelta(hours=hours)))


def backfill_currency(subscriptions: DataFrame, txns: DataFrame) -> DataFrame:
    """Take each subscription's currency from the transactions behind it."""
    seen = txns.groupBy(*SERIES).agg(F.min("currency").alias("_currency"))
    return (subscriptions.join(seen, SERIES, "left")
            .withColumn("currency", F.coalesce("_currency", "currency"))
            .select(*subscriptions.columns))


def export_tables(tables: dict[str, DataFrame], path: str, user_id: int | None = None,
                  everyone: bool = False) -> None:
    """Portability: six tables as JSON lines, one folder per table. `everyone`
    writes one folder per tenant below it; rebalancing splits a hot tenant over
    several files and packs small ones together."""
    for name in EXPORT_TABLES:
        df = tables[name]
        if everyone:
            (df.hint("rebalance", "user_id").write.mode("overwrite")
             .partitionBy("user_id").json(f"{path}/{name}"))
        else:
            for_tenant(df, user_id).write.mode("overwrite").json(f"{path}/{name}")
