"""Assembled results of detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.operators import series
from duebook.operators.folds import SPLIT_ROWS
from duebook.operators.series import SERIES, USAGE_CV, as_of_dates
from duebook.operators.skew import materialise, per_key_join


def assemble(found, points, amounts, cvs, as_of) -> DataFrame:
    """Join the facts of each series. `amounts` holds the counted charges of the
    found series only; `points` of all, for the currency."""
    rows = (found.join(series.current_amounts(amounts), SERIES)
            .join(series.series_currency(points), SERIES).join(cvs, SERIES, "left")
            .withColumn("cv", F.coalesce("cv", F.lit(0.0))))
    rows = per_key_join(rows, as_of, ["user_id"], ["merchant", "account_id"], weight="rows")
    period, last = F.col("period_days"), F.col("last_seen")
    return rows.select(
        *SERIES, "cadence", "period_days", "anchor_day", "current_amount_cents", "currency",
        (F.rint(F.col("cv") * 1000) / 1000).alias("amount_cv"), "charge_count", "first_seen",
        "last_seen", series.next_due(last, F.col("as_of"), F.col("cadence"), period,
                                     F.col("anchor_day")).alias("next_due"),
        series.status(last, F.col("as_of"), period).alias("status"),
        series.confidence(F.col("charge_count"), F.col("norm_dev"), F.col("cv"))
        .alias("confidence"), F.col("cv").alias("_cv"))


def _with_cadence(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (series with a cadence, their points). Days alone decide the cadence, and
    most series of a statement have none: only the rest goes on to amounts."""
    found = materialise(series.cadences(points))
    mine = per_key_join(points, found.select(*SERIES, "charge_count"), SERIES,
                        ["posted_date", "amount"], "left_semi", "charge_count")
    return found, mine


def detect(txns: DataFrame, split_rows: int | None = SPLIT_ROWS
           ) -> tuple[DataFrame, DataFrame]:
    """-> (subscriptions, price changes) of every tenant in `txns`.

    Steps are found first and the spread is measured within the levels they make;
    a series whose amount moves within a level has no price to change. Points,
    found series and levels are each read several times, so each is written once.
    """
    points = materialise(series.charge_points(txns))
    found, mine = _with_cadence(points)
    levels = materialise(series.price_levels(mine, split_rows))
    subs = materialise(assemble(found, points, levels, series.segmented_cv(levels),
                                as_of_dates(txns)))
    steady = subs.filter(F.col("_cv") <= USAGE_CV).select(*SERIES)
    old, new = F.col("old_amount_cents"), F.col("new_amount_cents")
    changes = (series.price_steps(levels).join(steady, SERIES, "left_semi")
               .withColumn("pct_change", F.rint((new - old) / old * 100 * 100) / 100))
    return subs.drop("_cv"), changes


def subscriptions_plain(txns: DataFrame) -> DataFrame:
    """Detection with the spread of the whole series instead of its levels: all
    native, no fold. Differs from :func:`detect` only where a price changed."""
    points = materialise(series.charge_points(txns))
    found, mine = _with_cadence(points)
    mine = materialise(mine)
    return assemble(found, points, mine, series.spread(mine, SERIES),
                    as_of_dates(txns)).drop("_cv")
