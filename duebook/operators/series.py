"""Charge series: cadence, price levels, amounts, forecast.

A series is the charges of one merchant on one account of one tenant. Charges are
counted by (series, day, amount) first, which combines before the shuffle; all
day-based statistics then see at most one row per calendar day, however many rows
a series has. Medians are exact and weighted by those counts.

Order inside a series is (day, amount): charges of one day have no order of their
own.
"""

from __future__ import annotations

import json
from bisect import insort

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook.functions.dates import days_in_month, month_day
from duebook.functions.money import whole
from duebook.operators.folds import SPLIT_ROWS, fold_groups
from duebook.operators.skew import materialise, per_key_join, top_rows

# ---- fixed values: name, period in days, tolerated median deviation ---------
CADENCES = (
    ("weekly", 7.0, 1.0),
    ("biweekly", 14.0, 2.0),
    ("semimonthly", 15.2, 2.0),
    ("monthly", 30.44, 3.0),
    ("quarterly", 91.3, 5.0),
    ("semiannual", 182.6, 8.0),
    ("annual", 365.25, 12.0),
)
MIN_CHARGES = 2
MAX_SKIPPED = 3
PRICE_TOLERANCE = 0.02
USAGE_CV = 0.02
DAY_TOLERANCE = 3
MONTH_END = 32
CANCELLED_AFTER, LAPSED_AFTER = 2.5, 1.5
RECENT = 3
# ---------------------------------------------------------------------------

SERIES = ["user_id", "merchant", "account_id"]


def period_of(cadence: Column) -> Column:
    return F.create_map(*(F.lit(x) for name, period, _ in CADENCES
                          for x in (name, period)))[cadence]


def weighted_median(value: Column, weight: Column) -> Column:
    """Exact interpolated median of `value` repeated `weight` times."""
    return F.percentile(value, F.lit(0.5), weight.cast("bigint"))


def median_distance(value: Column, middle: Column, weight: Column) -> Column:
    """Median absolute deviation from an already known median."""
    return weighted_median(F.abs(value - middle), weight)


def charge_points(txns: DataFrame) -> DataFrame:
    """Money out, attached to a merchant, counted by (series, day, amount, currency).

    The currency is a key and not a minimum: a text minimum would turn this hash
    aggregate over all charges into a sort.
    """
    return (txns.filter("merchant is not null and amount_cents < 0")
            .groupBy(*SERIES, "posted_date", (-F.col("amount_cents")).alias("amount"),
                     "currency")
            .agg(F.count("*").alias("n")))


def series_currency(points: DataFrame) -> DataFrame:
    """One currency per series (the least, should an account hold several)."""
    seen = points.groupBy(*SERIES, "currency").agg(F.count("*").alias("_n"))
    return seen.groupBy(*SERIES).agg(F.min("currency").alias("currency"))


def gap_fit(gap: Column, weight: Column, period: float) -> tuple[Column, Column, Column]:
    """Aggregates of one cadence: the median number of days by which gaps miss the
    nearest whole multiple of the period (at least one), the largest such multiple,
    and the number of gaps longer than one period."""
    k = F.greatest(F.lit(1.0), F.rint(gap / F.lit(period)))
    return (weighted_median(F.abs(gap - k * F.lit(period)), weight), F.max(k),
            F.sum(F.when(k > 1, weight).otherwise(0)))


def cadences(points: DataFrame) -> DataFrame:
    """Series with a cadence: (series, cadence, period_days, norm_dev, anchor_day,
    charge_count, first_seen, last_seen).

    One row per day enters; gaps and whole-series medians are windows over the
    series, and everything after them aggregates on the same partitioning.
    Charges sharing a day have gap 0, which is a full period off.
    """
    days = points.groupBy(*SERIES, "posted_date").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy(*SERIES).orderBy("posted_date")
    every = Window.partitionBy(*SERIES)
    day = F.dayofmonth("posted_date")
    n = F.col("n")
    seen = (days.withColumn("day", day)
            .withColumn("folded", F.when(day == days_in_month(F.col("posted_date")), MONTH_END)
                        .otherwise(day))
            .withColumn("gap", F.date_diff("posted_date", F.lag("posted_date").over(ordered)))
            .withColumn("day_mid", weighted_median(F.col("day"), n).over(every))
            .withColumn("folded_mid", weighted_median(F.col("folded"), n).over(every)))
    # Two weighted gaps per day: to the day before, and 0 between charges of one day.
    entry = F.explode(F.array(
        F.struct("gap", F.when(F.col("gap").isNull(), 0).otherwise(1).cast("bigint").alias("w"),
                 n.alias("nd")),
        F.struct(F.lit(0).alias("gap"), (n - 1).alias("w"),
                 F.lit(0).cast("bigint").alias("nd"))))
    gaps = (seen.withColumn("e", entry)
            .select(*SERIES, "posted_date", "day", "folded", "day_mid", "folded_mid",
                    "e.gap", "e.w", "e.nd")
            .filter("w > 0 or nd > 0"))
    w, nd = F.col("w"), F.col("nd")

    def near(value, middle):
        return F.sum(F.when(F.abs(F.col(value) - whole(F.col(middle))) <= DAY_TOLERANCE, nd)
                     .otherwise(0))

    aggregates = [
        F.sum("nd").alias("charge_count"), F.sum("w").alias("gaps"),
        F.min("posted_date").alias("first_seen"), F.max("posted_date").alias("last_seen"),
        F.first("day_mid").alias("day_mid"), F.first("folded_mid").alias("folded_mid"),
        near("day", "day_mid").alias("day_near"), near("folded", "folded_mid").alias("fold_near"),
        median_distance(F.col("day"), F.col("day_mid"), nd).alias("day_mad"),
        median_distance(F.col("folded"), F.col("folded_mid"), nd).alias("fold_mad")]
    for name, period, _ in CADENCES:
        dev, widest, skips = gap_fit(F.when(w > 0, F.col("gap")), w, period)
        aggregates += [dev.alias(f"{name}_dev"), widest.alias(f"{name}_k"),
                       skips.alias(f"{name}_skips")]
    facts = (gaps.groupBy(*SERIES).agg(*aggregates)
             .filter(F.col("charge_count") >= MIN_CHARGES))

    def day_score(near_count, mad, middle):
        """Infinite unless two thirds of the charges sit on the anchor."""
        anchored = F.col(near_count) * 3 >= F.col("charge_count") * 2
        return F.struct(F.when(anchored, F.col(mad)).otherwise(F.lit(float("inf"))).alias("dev"),
                        whole(F.col(middle)).alias("anchor"))

    best_day = F.array_min(F.array(day_score("day_near", "day_mad", "day_mid"),
                                   day_score("fold_near", "fold_mad", "folded_mid")))
    facts = facts.withColumn("best_day", best_day)

    def candidate(ordinal, name, period, tolerance):
        score = F.col(f"{name}_dev") / F.lit(tolerance)
        anchor = whole(F.col("day_mid"))
        if name == "monthly":
            score = F.least(score, F.col("best_day.dev") / F.lit(tolerance))
            anchor = F.least(F.col("best_day.anchor"), F.lit(31))
        fits = ((F.col(f"{name}_k") <= MAX_SKIPPED)
                & (F.col(f"{name}_skips") * 2 <= F.col("gaps")) & (score <= 1.0))
        return F.when(fits, F.struct(
            score.alias("norm_dev"), F.lit(ordinal).alias("ordinal"),
            F.lit(name).alias("cadence"), F.lit(period).alias("period_days"),
            anchor.cast("int").alias("anchor_day")))

    best = F.array_min(F.array(*(candidate(i, *c) for i, c in enumerate(CADENCES))))
    return (facts.withColumn("fit", best).filter("fit is not null")
            .select(*SERIES, "fit.cadence", "fit.period_days", "fit.norm_dev", "fit.anchor_day",
                    "charge_count", "first_seen", "last_seen"))


def day_anchors(points: DataFrame) -> DataFrame:
    """Per series: raw and month-end-folded day-of-month median (truncated)."""
    day = F.dayofmonth("posted_date")
    folded = F.when(day == days_in_month(F.col("posted_date")), MONTH_END).otherwise(day)
    return points.groupBy(*SERIES).agg(
        whole(weighted_median(day, F.col("n"))).alias("day_anchor"),
        whole(weighted_median(folded, F.col("n"))).alias("folded_anchor"))


def current_amounts(points: DataFrame) -> DataFrame:
    """Median of the last three charges, truncated to a whole minor unit."""
    last = top_rows(points.select(*SERIES, "posted_date", "amount", "n"), SERIES,
                    [F.desc("posted_date"), F.desc("amount")], RECENT)
    repeated = F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("posted_date", "amount", "n")), asc=False),
        lambda r: F.array_repeat(r["amount"], F.least(r["n"], F.lit(RECENT)).cast("int"))))
    recent = last.groupBy(*SERIES).agg(F.array_sort(F.slice(repeated, 1, RECENT)).alias("a"))
    size = F.size("a")
    low = F.element_at("a", F.floor((size + 1) / 2).cast("int"))
    high = F.element_at("a", (F.floor(size / 2) + 1).cast("int"))
    return recent.select(*SERIES, whole((low + high) / 2).alias("current_amount_cents"))


def spread(points: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """Robust coefficient of variation of the amounts per `keys`: median absolute
    deviation over median. Groups of one single amount (nearly all) stop after one
    pass; only the others are read again."""
    w = F.col(weight)
    first = materialise(points.groupBy(*keys).agg(
        weighted_median(F.col("amount"), w).alias("_mid"),
        (F.min("amount") < F.max("amount")).alias("_varies"), F.count("*").alias("_rows")))
    varied = per_key_join(points, first.filter("_varies").select(*keys, "_mid", "_rows"), keys,
                          ["posted_date", "amount"], weight="_rows")
    second = varied.groupBy(*keys).agg(
        median_distance(F.col("amount"), F.col("_mid"), w).alias("_mad"),
        F.first("_mid").alias("_mid"))
    cv = second.select(*keys, F.when(F.col("_mid") == 0, 0.0).otherwise(
        F.col("_mad") / F.abs("_mid")).alias("cv"))
    flat = first.filter(~F.col("_varies")).select(*keys, F.lit(0.0).alias("cv"))
    return flat.unionByName(cv)


class RunningMedian:
    """Counted amounts with their exact median. The pointer to the lower middle
    moves by neighbours, so an insert costs what moves, not what is held."""

    def __init__(self, counts=()):
        self.values = [v for v, _ in counts]
        self.count = dict(counts)
        self.total = sum(self.count.values())
        self.at = self.below = 0
        self._settle()

    def add(self, value: int, n: int) -> None:
        if value in self.count:
            self.count[value] += n
        else:
            if self.values and value < self.values[self.at]:
                self.at += 1
            insort(self.values, value)
            self.count[value] = n
        if self.total and value < self.values[self.at]:
            self.below += n
        self.total += n
        self._settle()

    def _settle(self) -> None:
        if not self.total:
            return
        low = (self.total - 1) // 2
        while self.below > low:
            self.at -= 1
            self.below -= self.count[self.values[self.at]]
        while self.below + self.count[self.values[self.at]] <= low:
            self.below += self.count[self.values[self.at]]
            self.at += 1

    def median(self):
        low = self.values[self.at]
        if self.total % 2 or self.below + self.count[low] > self.total // 2:
            return low
        return (low + self.values[self.at + 1]) / 2


class PriceLevels:
    """Step of the price fold. A level is a run of amounts within the tolerance of
    their running median. An amount outside it starts the next level if its
    successor lies within the tolerance of it, and is skipped if not."""

    results = 2

    def __init__(self, state: str | None):
        self.first, counts = json.loads(state) if state else (0, ())
        self.level = self.first
        self.given = {v: n for v, n in counts}
        self.run = RunningMedian(list(self.given.items()))

    def tail(self) -> str:
        """Steps found here and the open level's amounts; without a step, only
        those this chunk added to the level it was given."""
        before = {} if self.level > self.first else self.given
        added = [[v, self.run.count[v] - before.get(v, 0)] for v in self.run.values]
        return json.dumps([self.level - self.first, [a for a in added if a[1]]])

    @staticmethod
    def chain(state: str | None, tail: str) -> str:
        level, counts = json.loads(state) if state else (0, ())
        steps, added = json.loads(tail)
        total = {} if steps else {v: n for v, n in counts}
        for v, n in added:
            total[v] = total.get(v, 0) + n
        return json.dumps([level + steps, sorted(total.items())])

    def feed(self, row, following):
        amount, n = row[1], row[2]
        if not self.run.total:
            self.run.add(amount, n)
            return None, self.level
        base = self.run.median()
        if not base or abs(amount - base) / base <= PRICE_TOLERANCE:
            self.run.add(amount, n)
            return None, self.level
        after = amount if n > 1 else following[1] if following else None
        if after is None or abs(after - amount) / amount > PRICE_TOLERANCE:
            return None, self.level
        self.level += 1
        self.run = RunningMedian([(amount, n)])
        return int(base), self.level


def price_band() -> Column:
    """Grows with the amount and takes some hundred values over any money range."""
    return F.floor(F.log(F.col("amount").cast("double")) * 50)


def price_levels(points: DataFrame, split_rows: int | None = SPLIT_ROWS) -> DataFrame:
    """Points with ``old_amount`` (set where a confirmed new level starts) and
    ``level`` (how many levels precede the point)."""
    rows = points.select(*SERIES, F.unix_date("posted_date").alias("d"), "amount", "n")
    out = fold_groups(rows, SERIES, ["d", "amount"], PriceLevels,
                      "old_amount bigint, level bigint",
                      [F.col("d"), price_band()], split_rows)
    return out.select(*SERIES, F.date_from_unix_date("d").alias("posted_date"), "amount", "n",
                      "old_amount", "level")


def price_steps(levels: DataFrame) -> DataFrame:
    """Confirmed steps, the first of a day: (series, effective_date, old, new)."""
    return (levels.filter("old_amount is not null")
            .groupBy(*SERIES, F.col("posted_date").alias("effective_date"))
            .agg(F.min(F.struct("amount", "old_amount")).alias("s"))
            .select(*SERIES, "effective_date", F.col("s.old_amount").alias("old_amount_cents"),
                    F.col("s.amount").alias("new_amount_cents")))


def segmented_cv(levels: DataFrame) -> DataFrame:
    """Largest spread within a price level, per series. Every charge on a day with
    a step starts a level of its own, so of such a day only the last charge counts
    towards the level that goes on."""
    day = [*SERIES, "posted_date"]
    cut = levels.filter("old_amount is not null").select(*day).distinct()
    last = levels.join(cut, day, "left_semi").groupBy(*day).agg(
        F.max("level").alias("level"), F.max("amount").alias("amount"),
        F.lit(1).cast("bigint").alias("n"), F.count("*").alias("_rows"))
    last = materialise(last)
    rest = per_key_join(levels, last.select(*day, "_rows"), day, ["amount"], "left_anti", "_rows")
    last = last.drop("_rows")
    counted = rest.select(*last.columns).unionByName(last)
    return (spread(counted, [*SERIES, "level"]).groupBy(*SERIES)
            .agg(F.max("cv").alias("cv")))


def confidence(charges: Column, norm_dev: Column, cv: Column) -> Column:
    """Weighted sum of three parts between 0 and 1 (number of charges, fit of the
    cadence, steadiness of the amount), to 3 decimals."""
    score = (0.45 * F.least(F.lit(1.0), (charges - 1) / F.lit(4))
             + 0.40 * F.greatest(F.lit(0.0), 1.0 - norm_dev)
             + 0.15 * F.greatest(F.lit(0.0), 1.0 - F.least(cv, F.lit(1.0))))
    return F.rint(score * 1000) / 1000


def next_due(last: Column, as_of: Column, cadence: Column, period: Column,
             anchor: Column) -> Column:
    """The first charge after `as_of`, without a loop: the step that passes it is
    computed, however far ahead. Monthly and semimonthly walk the calendar and clamp
    to the month's length; everything else adds whole periods."""
    months = ((F.year(as_of) - F.year(last)) * 12 + F.month(as_of) - F.month(last))
    late = month_day(last, months, anchor) <= as_of
    k_month = F.greatest(F.lit(1), months + late.cast("int"))
    step = F.rint(period).cast("int")
    k_days = F.greatest(F.lit(1), F.floor(F.date_diff(as_of, last) / step) + 1)
    return (F.when(cadence.isin("monthly", "semimonthly"), month_day(last, k_month, anchor))
            .otherwise(F.date_add(last, (k_days * step).cast("int"))))


def status(last: Column, as_of: Column, period: Column) -> Column:
    """By the days of silence up to the tenant's newest transaction."""
    silent = F.date_diff(as_of, last)
    return (F.when(silent > CANCELLED_AFTER * period, "cancelled")
            .when(silent > LAPSED_AFTER * period, "lapsed").otherwise("active"))


def as_of_dates(txns: DataFrame) -> DataFrame:
    """Newest transaction per tenant, credits and unresolved rows included, and
    the number of rows (joins use it to know a hot tenant)."""
    return txns.groupBy("user_id").agg(F.max("posted_date").alias("as_of"),
                                       F.count("*").alias("rows"))
