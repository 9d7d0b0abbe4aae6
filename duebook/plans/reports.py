"""Reports over the tables, for all tenants at once; put ``for_tenant`` around one
to get a single tenant's. Money stays in minor units and every total carries its
currency. Lists are paged per tenant and say their ``position``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duebook.functions.money import (DEFAULT_CURRENCY, annualise, format_minor, minor_digits,
                                     minor_scale)
from duebook.operators.series import SERIES, USAGE_CV, period_of
from duebook.operators.skew import per_key_join, top_rows
from duebook.operators.tenancy import for_tenant

# ---- fixed values: list length, the two reasons -------------------------------
FREQUENT = 15
RENEWAL = "annual renewal ahead"
SILENT = "no charge for over a cycle -- cancelled, or a failed card"
# ---------------------------------------------------------------------------


def page(df: DataFrame, order: list, limit: int | None = None, offset: int = 0,
         keys: tuple = ("user_id",)) -> DataFrame:
    """All rows per key with their position; a page of them only if a limit is given."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if limit is not None:
        df = top_rows(df, list(keys), order, offset + int(limit))
    return df.withColumn("position", at).filter(F.col("position") > offset)


def whole_days(days) -> int:
    """The range as given; one that holds no day is refused."""
    if int(days) < 1:
        raise ValueError(f"a range of {days} days")
    return int(days)


def _currency() -> Column:
    named = F.when(F.col("currency") == "", None).otherwise(F.col("currency"))
    return F.upper(F.coalesce(named, F.lit(DEFAULT_CURRENCY)))


def costed(subs: DataFrame) -> DataFrame:
    """Subscriptions with yearly cost, usage flag and minor digits."""
    return (subs.withColumn("annual_cents", annualise(
        F.col("current_amount_cents"), period_of(F.col("cadence"))))
        .withColumn("usage_based", F.col("amount_cv") > USAGE_CV)
        .withColumn("minor_digits", minor_digits(F.coalesce("currency", F.lit("")))))


def pending_counts(queue: DataFrame) -> DataFrame:
    return (queue.filter("status = 'pending'").groupBy("user_id")
            .agg(F.count("*").alias("awaiting_review")))


def summary(subs: DataFrame, changes: DataFrame, as_of: DataFrame,
            queue: DataFrame) -> DataFrame:
    """Per tenant and currency: yearly and monthly cost of what is active, counts,
    the yearly effect of all price changes, and how much still waits for review. A
    tenant with data or a queue but no subscription has one row without currency."""
    rows = costed(subs).withColumn("currency", _currency())
    active = F.col("status") == "active"
    totals = rows.groupBy("user_id", "currency").agg(
        F.sum(F.when(active, F.col("annual_cents")).otherwise(0)).alias("annual_minor"),
        F.count_if(active).alias("active_count"), F.count_if(~active).alias("inactive_count"))
    effect = (changes.join(rows.select(*SERIES, "currency", "period_days"), SERIES)
              .groupBy("user_id", "currency")
              .agg(F.sum(annualise(F.col("new_amount_cents") - F.col("old_amount_cents"),
                                   F.col("period_days"))).alias("price_increase_annual_minor")))
    zero = F.lit(0).cast("bigint")
    tenants = as_of.join(pending_counts(queue), "user_id", "full")
    annual = F.coalesce("annual_minor", zero)
    return (tenants.join(totals.join(effect, ["user_id", "currency"], "left"), "user_id", "left")
            .select("user_id", "as_of", "currency", annual.alias("annual_minor"),
                    F.rint(annual / 12).cast("bigint").alias("monthly_minor"),
                    F.coalesce("active_count", zero).alias("active_count"),
                    F.coalesce("inactive_count", zero).alias("inactive_count"),
                    F.coalesce("price_increase_annual_minor", zero)
                    .alias("price_increase_annual_minor"),
                    minor_digits(F.col("currency")).alias("minor_digits"),
                    F.coalesce("awaiting_review", zero).alias("awaiting_review")))


def subscription_list(subs: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Dearest first."""
    rate = F.col("current_amount_cents") * (F.lit(365.25) / F.col("period_days"))
    return page(costed(subs), [rate.desc(), "merchant", "account_id"], limit, offset)


def filtered_list(subs: DataFrame, status: str = "active", min_annual: float = 0) -> DataFrame:
    """By status (or ``all``) and least yearly cost, in whole currency units."""
    rows = costed(subs)
    if status != "all":
        rows = rows.filter(F.col("status") == status)
    return rows.filter(F.col("annual_cents")
                       >= F.lit(float(min_annual)) * minor_scale(F.col("currency")))


def upcoming(subs: DataFrame, as_of: DataFrame, days: int = 30) -> DataFrame:
    """Active charges due up to `days` after the tenant's newest data."""
    dated = per_key_join(subs.filter("status = 'active'"), as_of, ["user_id"],
                         ["merchant", "account_id"], weight="rows")
    return (dated.filter(F.col("next_due") <= F.date_add("as_of", whole_days(days)))
            .select("user_id", "next_due", "merchant", "account_id", "current_amount_cents",
                    "currency", "cadence"))


def upcoming_totals(due: DataFrame) -> DataFrame:
    return due.groupBy("user_id", "currency").agg(
        F.count("*").alias("charges"), F.sum("current_amount_cents").alias("total_cents"))


def price_increases(changes: DataFrame, subs: DataFrame, limit: int | None = None,
                    offset: int = 0) -> DataFrame:
    """Price changes, newest first, with what each adds per year."""
    rows = changes.join(subs.select(*SERIES, "period_days", "currency"), SERIES)
    rows = rows.withColumn("annual_impact_cents", annualise(
        F.col("new_amount_cents") - F.col("old_amount_cents"), F.col("period_days")))
    return page(rows, [F.desc("effective_date"), "merchant", "account_id"], limit, offset)


def history(txns: DataFrame, subs: DataFrame, limit: int | None = None,
            offset: int = 0) -> DataFrame:
    """The charges behind each subscription, oldest first."""
    charges = txns.filter("amount_cents < 0 and merchant is not null").select(
        *SERIES, "posted_date", (-F.col("amount_cents")).alias("amount_cents"))
    rows = per_key_join(charges, subs.select(*SERIES, "charge_count"), SERIES,
                        ["posted_date", "amount_cents"], "left_semi", "charge_count")
    return page(rows, ["posted_date", "amount_cents"], limit, offset, tuple(SERIES))


def review_queue(queue: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """What waits for a person, most frequent descriptor first."""
    return page(queue.filter("status = 'pending'"), [F.desc("txn_count"), "scrubbed"],
                limit, offset)


def spending_summary(subs: DataFrame, changes: DataFrame, as_of: DataFrame,
                     queue: DataFrame) -> DataFrame:
    """The summary in whole currency units, one row per currency: currencies are
    never added up."""
    s = summary(subs, changes, as_of, queue)
    scale = minor_scale(F.col("currency"))

    def major(c):
        return F.col(c) / scale
    return s.select(
        "user_id", F.col("as_of").alias("statement_through"), "currency",
        major("annual_minor").alias("annual"), major("monthly_minor").alias("monthly"),
        F.col("active_count").alias("active_subscriptions"),
        F.col("inactive_count").alias("inactive_subscriptions"),
        major("price_increase_annual_minor").alias("annual_cost_added_by_price_rises"),
        F.col("awaiting_review").alias("descriptors_awaiting_review"))


def forgotten(subs: DataFrame) -> DataFrame:
    """Yearly renewals ahead, and what lapsed rather than ended."""
    reason = (F.when(F.col("cadence").isin("annual", "semiannual")
                     & (F.col("status") == "active"), RENEWAL)
              .when(F.col("status") == "lapsed", SILENT))
    return (subs.withColumn("reason", reason).filter("reason is not null")
            .select(*SERIES, "reason", "next_due", "last_seen", "current_amount_cents",
                    "currency"))


def data_quality(txns: DataFrame, merchants: DataFrame, queue: DataFrame) -> DataFrame:
    """How much resolved by itself. The waiting descriptors are rows of
    :func:`review_queue`, not a list in one cell, however many there are."""
    t = txns.groupBy("user_id").agg(
        F.count("*").alias("transactions"),
        F.count_if(F.col("merchant").isNotNull()).alias("resolved_to_a_merchant"))
    m = merchants.groupBy("user_id").agg(F.count("*").alias("merchants"))
    zero = F.lit(0).cast("bigint")
    share = F.col("resolved_to_a_merchant") / F.col("transactions")
    return (t.join(m, "user_id", "left").join(pending_counts(queue), "user_id", "left")
            .select("user_id", "transactions", "resolved_to_a_merchant",
                    (F.rint(share * 1000) / 10).alias("resolved_pct"),
                    F.coalesce("merchants", zero).alias("merchants"),
                    F.coalesce("awaiting_review", zero).alias("awaiting_human_review")))


def frequent_merchants(txns: DataFrame, n: int = FREQUENT) -> DataFrame:
    """Per account: the descriptors charged most often, then the dearest."""
    counted = (txns.filter("amount_cents < 0")
               .groupBy("user_id", "account_id", "scrubbed")
               .agg(F.count("*").alias("charges"), F.sum("amount_cents").alias("total_cents")))
    return top_rows(counted, ["user_id", "account_id"],
                    [F.desc("charges"), "total_cents", "scrubbed"], n)


def variant_groups(txns: DataFrame) -> DataFrame:
    """Merchants with more than one descriptor: one row per variant, with the
    number of variants and charges of the merchant."""
    variants = (txns.filter("merchant is not null").groupBy("user_id", "merchant", "scrubbed")
                .agg(F.count("*").alias("variant_charges")))
    groups = (variants.groupBy("user_id", "merchant")
              .agg(F.count("*").alias("variants"), F.sum("variant_charges").alias("charges"))
              .filter("variants > 1"))
    return per_key_join(variants, groups, ["user_id", "merchant"], ["scrubbed"],
                        weight="variants")


def understatement(queue: DataFrame) -> DataFrame:
    """Descriptors, and charges, that no total counts yet."""
    return queue.filter("status = 'pending'").groupBy("user_id").agg(
        F.count("*").alias("descriptors"),
        F.coalesce(F.sum("txn_count"), F.lit(0)).alias("charges"))


def detected_totals(subs: DataFrame) -> DataFrame:
    """Yearly cost of the active series per currency, added up in millionths."""
    rate = (F.col("current_amount_cents") * (F.lit(365.25) / F.col("period_days"))
            ).cast("decimal(28,6)")
    return (subs.filter("status = 'active'")
            .groupBy("user_id", _currency().alias("currency"))
            .agg(F.rint(F.sum(rate)).cast("bigint").alias("annual_cents")))


def cost_shares(subs: DataFrame) -> DataFrame:
    """Yearly cost relative to the tenant's dearest in the same currency."""
    rows = costed(subs)
    top = rows.groupBy("user_id", "currency").agg(
        F.greatest(F.max("annual_cents"), F.lit(1)).alias("_top"), F.count("*").alias("_rows"))
    return (per_key_join(rows, top, ["user_id", "currency"], ["merchant", "account_id"],
                         weight="_rows")
            .select(*SERIES, "currency", "annual_cents",
                    (F.col("annual_cents") / F.col("_top")).alias("cost_share")))


def displayed(subs: DataFrame) -> DataFrame:
    """Amounts as text in their own currency."""
    rows = costed(subs)
    return rows.select(*SERIES, "status",
                       format_minor(F.col("current_amount_cents"), F.col("currency"))
                       .alias("amount"),
                       format_minor(F.col("annual_cents"), F.col("currency")).alias("per_year"))


def load_report(facts: DataFrame, new_txns: DataFrame, outcomes: DataFrame | None = None,
                subs: DataFrame | None = None) -> DataFrame:
    """Per file: lines read, skipped, new and duplicate, sign flip, empty names,
    and per tenant what resolution and detection made of it."""
    key = ["user_id", "source_file"]
    new = new_txns.groupBy(*key).agg(F.count("*").alias("rows_new"),
                                     F.count_if(F.col("scrubbed") == "").alias("empty_names"))
    zero = F.lit(0).cast("bigint")
    report = (facts.filter("reason is null").join(new, key, "left")
              .select(*key, "rows_read", "rows_skipped",
                      F.coalesce("rows_new", zero).alias("rows_new"),
                      (F.col("rows_read") - F.coalesce("rows_new", zero)).alias("rows_duplicate"),
                      "sign_flipped", F.coalesce("empty_names", zero).alias("empty_names")))
    if outcomes is not None:
        tiers = outcomes.groupBy("user_id").pivot(
            "tier", ["exact", "fuzzy", "new", "queued"]).agg(F.sum("n"))
        report = per_key_join(report, tiers, ["user_id"], ["source_file"], "left").na.fill(
            0, ["exact", "fuzzy", "new", "queued"])
    if subs is not None:
        found = subs.groupBy("user_id").agg(F.count("*").alias("subscriptions_found"))
        report = per_key_join(report, found, ["user_id"], ["source_file"], "left").na.fill(
            0, ["subscriptions_found"])
    return report


def mixed_currency_series(txns: DataFrame) -> DataFrame:
    """Series whose account received more than one currency."""
    return (txns.filter("merchant is not null and amount_cents < 0").groupBy(*SERIES)
            .agg(F.min("currency").alias("first_currency"),
                 F.max("currency").alias("last_currency"))
            .filter("first_currency <> last_currency"))


# --------------------------------------------------------- named reports --
# name -> (builder over the tables, allowed arguments)
NAMED: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {
    "list_subscriptions": (
        lambda t, status="active", min_annual=0: filtered_list(
            t["subscription"], status, min_annual), ("status", "min_annual")),
    "spending_summary": (
        lambda t: spending_summary(t["subscription"], t["price_change"], t["as_of"],
                                   t["resolution_queue"]), ()),
    "upcoming_charges": (
        lambda t, days=30: upcoming(t["subscription"], t["as_of"], days), ("days",)),
    "price_increases": (
        lambda t: price_increases(t["price_change"], t["subscription"]), ()),
    "find_forgotten": (lambda t: forgotten(t["subscription"]), ()),
    "data_quality": (
        lambda t: data_quality(t["raw_transaction"], t["merchant"], t["resolution_queue"]), ()),
}


def call(tables: dict[str, DataFrame], user_id: int, name: str,
         arguments: dict | None = None) -> DataFrame:
    """Run a named report for one tenant. Raises KeyError for an unknown name;
    arguments the report does not list are ignored, a tenant among them."""
    return call_for_all({k: for_tenant(df, user_id) for k, df in tables.items()}, name, arguments)


def call_for_all(tables: dict[str, DataFrame], name: str,
                 arguments: dict | None = None) -> DataFrame:
    """A named report of every tenant, in one plan; its rows carry their tenant."""
    builder, allowed = NAMED[name]
    return builder(tables, **{k: v for k, v in (arguments or {}).items() if k in allowed})
