"""Attempt-rate analytics over a log of (kind, key, at)."""

from __future__ import annotations

import json
import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook.operators.folds import SPLIT_ROWS, fold_groups

# ---- fixed values: kind -> (most attempts, window in seconds) ----------------
LIMITS = {"login": (8, 900), "register": (5, 3600), "reset": (5, 3600), "upload": (20, 3600)}
# ---------------------------------------------------------------------------

MICROS = 1_000_000
HOUR = 3600 * MICROS
NEVER = 2 ** 62
KEY = ["kind", "key"]


def _by_kind(values: dict[str, int]) -> Column:
    """A setting per kind; kinds without one give NULL."""
    return F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in values.items())).cast("bigint")


def trailing_rate(attempts: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """Adds ``recent`` (other attempts of the key in the window before, bounds
    exclusive on the far side) and ``flagged`` (recent >= limit).

    A row lies in one window-wide time slot and is copied into the next, so every
    partition spans two slots and a key busy for months is many partitions. Time is
    counted from the slot's start and stretched to the common multiple of all
    windows, so that one frame serves every kind in one pass. Attempts of a kind
    without a limit stay, never flagged and without ``recent``.
    """
    common = math.lcm(*(seconds for _, seconds in limits.values()))
    rows = (attempts.withColumn("_limit", _by_kind({k: n for k, (n, _) in limits.items()}))
            .withColumn("_width", _by_kind({k: s * MICROS for k, (_, s) in limits.items()}))
            .withColumn("_stretch", _by_kind({k: common // s for k, (_, s) in limits.items()}))
            .filter("_limit is not null")
            .withColumn("_own", F.expr("unix_micros(at) div _width"))
            .withColumn("_slot", F.explode(F.array("_own", F.col("_own") + 1)))
            .withColumn("_time", (F.unix_micros("at") - F.col("_own") * F.col("_width")
                                  - F.when(F.col("_slot") > F.col("_own"), F.col("_width"))
                                  .otherwise(0)) * F.col("_stretch")))
    before = (Window.partitionBy(*KEY, "_slot").orderBy("_time")
              .rangeBetween(-(common * MICROS - 1), 0))
    counted = (rows.withColumn("recent", F.count("*").over(before) - 1).filter("_own = _slot")
               .withColumn("flagged", F.col("recent") >= F.col("_limit"))
               .select(*attempts.columns, "recent", "flagged"))
    return counted.union(without_limit(attempts, limits).withColumn(
        "recent", F.lit(None).cast("bigint")).withColumn("flagged", F.lit(False)))


def without_limit(attempts: DataFrame, limits) -> DataFrame:
    limit = _by_kind({k: n for k, (n, _) in limits.items()})
    return attempts.filter(limit.isNull())


class AcceptedOnly:
    """Step of the replay: holds at most `limit` accepted times."""

    results = 1

    def __init__(self, state: str | None):
        self.accepted = deque(json.loads(state) if state else ())

    def tail(self) -> str:
        return json.dumps(list(self.accepted))

    @staticmethod
    def chain(state: str | None, tail: str) -> str:
        return tail

    def feed(self, row, following):
        at, limit, width, cleared = row[:4]
        while self.accepted and self.accepted[0] <= at - width:
            self.accepted.popleft()
        if len(self.accepted) >= limit:
            return (False,)
        self.accepted.append(at)
        if cleared:
            self.accepted.clear()
        return (True,)


def with_limits(attempts: DataFrame, limits) -> DataFrame:
    """The attempts with their kind's limit and window; kinds without one have a limit
    that is never reached."""
    limit = _by_kind({k: n for k, (n, _) in limits.items()})
    width = _by_kind({k: seconds * MICROS for k, (_, seconds) in limits.items()})
    cleared = F.col("cleared") if "cleared" in attempts.columns else F.lit(False)
    return attempts.select(
        *KEY, F.unix_micros("at").alias("us"), F.coalesce(limit, F.lit(NEVER)).alias("limit"),
        F.coalesce(width, F.lit(1)).cast("bigint").alias("width"), cleared.alias("cleared"),
        *(c for c in attempts.columns if c not in (*KEY, "at", "cleared")))


def replay(attempts: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS,
           split_rows: int | None = SPLIT_ROWS) -> DataFrame:
    """What the limiter would have answered: ``accepted`` per attempt. A refused
    attempt is not recorded, so it does not count against later ones; an accepted
    one marked ``cleared`` wipes its key's record. Kinds without a limit are accepted."""
    free = without_limit(attempts, limits)
    limited = _by_kind({k: n for k, (n, _) in limits.items()}).isNotNull()
    rows = with_limits(attempts.filter(limited), limits)
    rest = [c for c in rows.columns if c not in KEY]
    out = fold_groups(rows, KEY, rest, AcceptedOnly, "accepted boolean",
                      [F.floor(F.col("us") / F.lit(HOUR))], split_rows)
    return out.withColumn("at", F.timestamp_micros("us")).select(
        *attempts.columns, "accepted").union(free.withColumn("accepted", F.lit(True)))
