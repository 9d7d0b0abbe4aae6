"""Registered queries: every operator run over the whole given tables.

The tables hold no bank statements, so Spark derives them (``sources.views``):
part lines are regular charges, event lines irregular ones, order lines span years.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.functions import similarity
from duebook.functions.dates import parse_date
from duebook.functions.descriptors import scrub
from duebook.functions.identity import dedup_key
from duebook.functions.money import (annualise, format_minor, minor_digits, parse_amount,
                                     to_minor)
from duebook.operators import attempts, evaluation, load, merge, resolve, series, tenancy
from duebook.operators.series import SERIES
from duebook.operators.skew import materialise, shared_folder
from duebook.operators.subscriptions import detect, subscriptions_plain
from duebook.plans import reports
from duebook.sources import schemas, splits, statements, views

LIMITS = {"click": (8, 900), "view": (5, 3600), "error": (2, 86400), "purchase": (3, 43200)}
CUT = dt.datetime(2024, 1, 20)


# ------------------------------------------------------------------ inputs --
def part_txns(spark, d):
    return views.exact_transactions(views.part_lines(spark, d))


def event_txns(spark, d):
    return views.exact_transactions(views.event_lines(spark, d))


def order_txns(spark, d):
    return views.exact_transactions(views.order_lines(spark, d))


def review_items(spark, d):
    """A review queue drawn from the orders: one item per customer and priority."""
    o = views.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    return (o.groupBy(F.col("o_custkey").alias("user_id"),
                      F.col("o_orderpriority").alias("scrubbed"))
            .agg(F.count("*").alias("txn_count"), F.max("o_orderkey").alias("_k"))
            .select("user_id", "scrubbed", "txn_count",
                    F.lit(None).cast("array<struct<name:string,score:double>>")
                    .alias("candidates"),
                    (F.col("_k") % 101).cast("double").alias("top_score"),
                    F.lit("borderline").alias("reason"),
                    F.when(F.col("_k") % 3 == 0, "pending").when(F.col("_k") % 3 == 1, "resolved")
                    .otherwise("ignored").alias("status")))


def attempt_log(spark, d):
    e = views.read(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    return e.select(F.col("event_type").alias("kind"),
                    F.col("user_id").cast("string").alias("key"),
                    F.col("ts").cast("timestamp").alias("at"),
                    "event_id", (F.col("event_id") % 7 == 0).alias("cleared"))


def detected(spark, d, txns=None):
    txns = part_txns(spark, d) if txns is None else txns
    subs, changes = detect(txns)
    return txns, subs, changes, series.as_of_dates(txns)


# ------------------------------------------------------- scalar functions --
def scrub_descriptors(spark, d):
    raw = (views.part_lines(spark, d).select("raw_descriptor")
           .unionByName(views.event_lines(spark, d).select("raw_descriptor"))
           .unionByName(views.read(spark, d, "customer", "c_name", "c_mktsegment").select(
               F.concat(F.lit("CHECKCARD 0803 "), "c_name", F.lit(" "), "c_mktsegment",
                        F.lit(" 408-536-6000 NY")).alias("raw_descriptor"))))
    return (raw.groupBy("raw_descriptor").agg(F.count("*").alias("lines"))
            .withColumn("scrubbed", scrub(F.col("raw_descriptor"))))


def amount_texts(spark, d):
    """Line prices written in eight ways."""
    li = views.read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    units, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    us = F.format_number(units, 0)
    eu = F.translate(us, ",", ".")
    form = (F.col("l_orderkey") + F.col("l_linenumber")) % 8
    text = (F.when(form == 0, F.concat(F.lit("$"), us, F.lit("."), rest))
            .when(form == 1, F.concat(F.lit("-"), eu, F.lit(","), rest))
            .when(form == 2, F.concat(F.lit("("), us, F.lit("."), rest, F.lit(")")))
            .when(form == 3, F.concat(F.translate(us, ",", " "), F.lit(","), rest))
            .when(form == 4, F.concat(F.lit(" "), us, F.lit(" USD")))
            .when(form == 5, F.concat(us, F.lit(".00")))
            .when(form == 6, F.concat(units.cast("string"), F.lit("."), rest, F.lit("0")))
            .otherwise(F.concat(us, F.lit("."), rest, F.lit("."), rest)))
    currency = (F.when(form == 5, "JPY").when(form == 6, "KWD").otherwise("USD"))
    return li.select("l_orderkey", "l_linenumber", text.alias("raw"),
                     currency.alias("currency"))


def parsed_amounts(spark, d):
    return amount_texts(spark, d).withColumn(
        "amount", parse_amount(F.col("raw"), F.col("currency")))


def parsed_dates(spark, d):
    o = views.read(spark, d, "orders", "o_orderkey", "o_orderdate")
    day, form = F.to_date("o_orderdate"), F.col("o_orderkey") % 15
    layouts = ("MM/dd/yyyy", "M/d/yy", "yyyy-MM-dd", "MM-dd-yyyy", "yyyy/M/d", "dd-MMM-yyyy",
               "MMM d, yyyy", "d MMM yyyy", "dd.MM.yyyy",
               # and some that are not read
               "dd-MM-yy", "yy-MM-dd", "dd-MMM-yy", "yyyy-MMM-dd", "yyyyMMdd",
               "yyyy-MM-dd HH:mm")
    text = F.coalesce(*(F.when(form == i, F.date_format(day, f)) for i, f in enumerate(layouts)))
    texts = o.select("o_orderkey", text.alias("raw"))
    return texts.select("o_orderkey", "raw",
                        parse_date(F.col("raw"), False).alias("month_first"),
                        parse_date(F.col("raw"), True).alias("day_first"))


def money_columns(spark, d):
    o = views.read(spark, d, "orders", "o_orderkey", "o_totalprice")
    currency = F.element_at(F.array(*(F.lit(c) for c in ("usd", "JPY", "KWD", "EUR"))),
                            (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = o.withColumn("currency", currency)
    minor = to_minor(F.col("o_totalprice"), F.col("currency"))
    o = o.withColumn("minor", minor)
    return o.select("o_orderkey", "currency", minor_digits(F.col("currency")).alias("digits"),
                    "minor", format_minor(F.col("minor"), F.col("currency")).alias("shown"),
                    annualise(F.col("minor"), F.lit(30.44)).alias("annual"))


def dedup_keys(spark, d):
    lines = views.event_lines(spark, d)
    return load.occurrences(lines).select(
        "user_id", "account_id", "posted_date", "amount_cents", "raw_descriptor", "source_file",
        "occurrence", dedup_key(*(F.col(c) for c in (
            "user_id", "account_id", "posted_date", "amount_cents", "raw_descriptor",
            "occurrence"))).alias("dedup_hash"))


# ------------------------------------------------------------- statements --
def statement_fields(spark, d):
    files = views.event_files(spark, d).select(
        "user_id", (F.col("user_id") % 3).alias("account_id"), F.lit("USD").alias("currency"),
        F.lit(False).alias("dayfirst"), F.lit(None).cast("boolean").alias("flip_sign"),
        F.col("path").alias("source_file"), "content")
    return statements.split_files(files)


def statement_lines(spark, d):
    typed = statements.typed_lines(statement_fields(spark, d))
    return typed.select("user_id", "account_id", "source_file", "posted_date", "amount_cents",
                        "raw_descriptor", "usable")


def split_statement_lines(spark, d):
    """Lines of statement files in folders, read in byte ranges."""
    root = f"{shared_folder(spark)}/statements-{uuid.uuid4().hex}"
    views.write_statements(spark, d, root)
    files = statements.files_under(spark, root).withColumn(
        "account_id", F.col("label").cast("bigint"))
    return statements.typed_lines(splits.read_fields(files, root)).select(
        "user_id", "account_id", "posted_date", "amount_cents", "raw_descriptor", "usable")


def statement_files(spark, d):
    typed = statements.typed_lines(statement_fields(spark, d))
    return statements.file_facts(typed).drop("reason")


def rejected_files(spark, d):
    """Event files, eleven of twelve of which are spoilt in one way each."""
    f = views.event_files(spark, d)
    k, user, empty = F.col("user_id") % 12, F.col("user_id").cast("string"), F.lit(b"")
    files = f.select(
        F.concat(F.lit("file:/drop"),
                 F.when(k == 6, F.lit("")).otherwise(F.concat(F.lit("/user_id="), user)),
                 F.lit("/account="), F.when(k == 7, F.repeat(F.lit("x"), 70)).otherwise("card"),
                 F.lit("/currency="), F.when(k == 8, "EURO").otherwise("EUR"), F.lit("/"),
                 F.regexp_replace("path", "/", "-"),
                 F.when(k == 5, ".png").otherwise(F.lit(""))).alias("path"),
        F.lit(0).cast("timestamp").alias("modificationTime"),
        F.when(k == 0, empty).when(k == 1, F.concat("content", F.lit(b"\x00")))
        .when(k == 2, F.lit(b"Date,Description,Amount\n"))
        .when(k == 3, F.lit(b"Date,Payee\n2024-01-01,x\n"))
        .when(k == 4, F.lit(b"When,Payee,Amount\n2024-01-01,x,1\n"))
        .when(k == 9, F.lit(b"\x81\x8d"))
        .when(k == 10, F.lit(b"Date,Payee,Amount\n31-12-24,x,1\n"))
        .otherwise(F.col("content")).alias("content"))
    described = statements.describe_files(files.withColumn("length", F.length("content")))
    opened = statements.readable_files(described).withColumn(
        "account_id", F.lit(1).cast("bigint"))
    fields = materialise(statements.split_files(opened))
    facts = statements.file_facts(statements.typed_lines(fields))
    return statements.rejects(described, fields, facts).select(
        "user_id", F.regexp_extract("source_file", "/(drop-[^/]*)$", 1).alias("file"), "reason")


def signed_statement_lines(spark, d):
    typed = materialise(statements.typed_lines(statement_fields(spark, d)))
    return statements.signed_lines(typed, statements.file_facts(typed))


def sign_conventions(spark, d):
    """Files whose amounts are mostly positive, over order lines with mixed signs."""
    lines = views.order_lines(spark, d).withColumn("amount_cents", F.when(
        F.dayofmonth("posted_date") % 8 < 1 + F.col("user_id") % 7,
        -F.col("amount_cents")).otherwise(F.col("amount_cents")))
    flips = load.flipped_files(lines)
    return (load.apply_sign(lines, flips).groupBy(*load.FILE)
            .agg(F.count("*").alias("lines"), F.sum("amount_cents").alias("total_cents"))
            .join(flips.drop("lines"), load.FILE))


# -------------------------------------------------------- load and tables --
def _two_uploads(spark, d):
    """Event lines with some charges repeated inside a file, and a second file
    that overlaps the first."""
    e = views.event_lines(spark, d).withColumn("source_file", F.lit("a.csv"))
    e = e.withColumn("raw_descriptor", F.substring_index("raw_descriptor", " #", 1))
    e = e.withColumn("amount_cents", F.floor(F.col("amount_cents") / 500) * 500)
    again = e.filter(F.col("account_id") < 2).withColumn("source_file", F.lit("b.csv"))
    return e.unionByName(again)


def idempotent_load(spark, d):
    lines = _two_uploads(spark, d)
    early = load.new_transactions(lines.filter(F.dayofmonth("posted_date") <= 10))
    return load.new_transactions(lines, early).drop("merchant")


def reload_is_noop(spark, d):
    lines = _two_uploads(spark, d)
    first = load.new_transactions(lines)
    second = load.new_transactions(lines, first)
    return first.agg(F.count("*").alias("first_load")).crossJoin(
        second.agg(F.count("*").alias("second_load")))


def account_upsert(spark, d):
    c = views.read(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    now = dt.datetime(2026, 1, 1)
    def uploads(currency):
        return c.select(F.col("c_nationkey").cast("bigint").alias("user_id"),
                        F.col("c_mktsegment").alias("label"), "c_custkey",
                        F.lit(currency).alias("currency"))
    old = load.upsert_accounts(
        spark.createDataFrame([], "account_id bigint, user_id bigint, label string, "
                                  "institution string, currency string, created_at timestamp"),
        uploads("USD").filter("c_custkey % 13 = 0"), now)
    return load.upsert_accounts(old, uploads("EUR"), now).drop("account_id")


def merged_keep_first(spark, d):
    """First charge per customer and priority, old orders before new ones."""
    o = views.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority",
                   "o_totalprice")
    key = ["o_custkey", "o_orderpriority"]
    old = merge.first_per_key(o.filter("o_orderkey % 2 = 0"), key, ["o_orderkey"])
    return merge.merge_keep_first(old, o.filter("o_orderkey % 2 = 1"), key, ["o_orderkey"])


def queue_upsert(spark, d):
    """Conflicts refresh count and score; reason and status stay."""
    q = review_items(spark, d).drop("candidates")
    old = q.filter("user_id % 2 = 0")
    new = q.filter("user_id % 2 = 1 or user_id % 3 = 0").select(
        "user_id", "scrubbed", (F.col("txn_count") * 10).alias("txn_count"),
        F.lit(None).cast("double").alias("top_score"), F.lit("ambiguous").alias("reason"),
        F.lit("pending").alias("status"))
    return merge.merge_update(old, new, resolve.NEEDLE, ["txn_count", "top_score"])


def tenant_rows(spark, d):
    return tenancy.for_tenant(event_txns(spark, d), 7).drop("merchant")


def no_tenant_rows(spark, d):
    """A list of tenants in which every second one is unknown: those see nothing."""
    listed = views.read(spark, d, "customer", "c_custkey").select(F.when(
        F.col("c_custkey") % 2 == 1, F.col("c_custkey")).alias("user_id"))
    anyone = event_txns(spark, d).withColumn("user_id", F.when(
        F.col("user_id") % 3 > 0, F.col("user_id")))
    return tenancy.only_tenants(anyone, listed).groupBy("user_id").agg(
        F.count("*").alias("rows"))


def erased_tables(spark, d):
    users = views.read(spark, d, "customer", "c_custkey").select(
        F.col("c_custkey").alias("user_id")).filter("user_id % 5 = 0")
    left = tenancy.erase({"order": order_txns(spark, d), "event": event_txns(spark, d)}, users)
    return (left["order"].groupBy("user_id").agg(F.count("*").alias("rows"))
            .withColumn("source", F.lit("order"))
            .unionByName(left["event"].groupBy("user_id").agg(F.count("*").alias("rows"))
                         .withColumn("source", F.lit("event"))))


def purged_attempts(spark, d):
    return tenancy.purge_older(attempt_log(spark, d), "at", CUT, 24).select(
        "kind", "key", "event_id")


def replaced_derived(spark, d):
    txns = event_txns(spark, d)
    old = txns.groupBy("user_id").agg(F.count("*").alias("charges"))
    affected = txns.filter("user_id % 4 = 1").select("user_id").distinct()
    new = tenancy.only_tenants(txns, affected).groupBy("user_id").agg(
        (F.count("*") * 100).alias("charges"))
    return tenancy.replace_derived(old, new, affected)


def backfilled_currency(spark, d):
    txns = part_txns(spark, d)
    bare = subscriptions_plain(txns).withColumn("currency", F.lit("USD"))
    return tenancy.backfill_currency(bare, txns).select(*SERIES, "currency")


# ------------------------------------------------------------- resolution --
def name_similarity(spark, d):
    """Each part's name against the next part's and against its own despaced form."""
    p = views.read(spark, d, "part", "p_partkey", "p_name", "p_type")
    name = F.concat(F.upper("p_name"), F.lit(" "), "p_type")
    here = p.select("p_partkey", name.alias("a"))
    following = here.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    pairs = here.join(following, "p_partkey").unionByName(here.select(
        "p_partkey", "a", F.replace("a", F.lit(" "), F.lit("")).alias("b")))
    distinct = pairs.groupBy("a", "b").agg(F.count("*").alias("parts"))
    a, b = F.col("a"), F.col("b")
    return distinct.select("a", "b", "parts",
                           F.round(similarity.token_set_score("a", "b"), 6).alias("token_set"),
                           F.round(similarity.partial_score("a", "b"), 6).alias("partial"),
                           similarity.held_column(a, b).alias("held"))


def resolution_state(spark, d, lines=None):
    txns = (lines or views.part_lines)(spark, d)
    txns = (txns.withColumn("scrubbed", scrub(F.col("raw_descriptor")))
            .withColumn("merchant", F.lit(None).cast("string"))
            .withColumn("dedup_hash", F.sha2(F.concat_ws(
                "|", "user_id", "account_id", "posted_date", "raw_descriptor"), 256)))
    none = spark.createDataFrame
    # Resolution reads the charges several times; their names are scrubbed once.
    return resolve.State(materialise(txns), none([], schemas.MERCHANT), none([], schemas.MERCHANT_ALIAS),
                         none([], schemas.RESOLUTION_QUEUE))


def _as_text(candidates):
    """Names and scores (in thousandths) as one comparable text."""
    shown = F.transform(candidates, lambda c: F.concat(
        c["name"], F.lit(":"), F.rint(c["score"] * 1000).cast("bigint").cast("string")))
    return F.when(F.col(candidates).isNotNull(), F.array_join(shown, "|"))


def resolution_outcomes(spark, d):
    _, outcomes = resolve.resolve(resolution_state(spark, d))
    return outcomes.withColumn("score", F.round("score", 6)).withColumn(
        "candidates", _as_text("candidates"))


def resolution_tiers(spark, d):
    _, outcomes = resolve.resolve(resolution_state(spark, d))
    return resolve.tier_stats(outcomes)


def founders(spark, d):
    state = resolution_state(spark, d)
    return resolve.select_founders(resolve.unresolved_counts(state.transactions),
                                   state.merchants)


def resolved_transactions(spark, d):
    state, _ = resolve.resolve(resolution_state(spark, d))
    return state.transactions.select(*SERIES, "scrubbed", "posted_date", "amount_cents")


def queued_candidates(spark, d):
    state, _ = resolve.resolve(resolution_state(spark, d))
    return state.queue.select("user_id", "scrubbed", "txn_count", "top_score", "reason",
                              _as_text("candidates").alias("candidates"))


def resolved_aliases(spark, d):
    """The alias table after a run: who resolved a descriptor, and how surely."""
    state, _ = resolve.resolve(resolution_state(spark, d))
    return state.aliases


def exact_tier(spark, d):
    """Every descriptor already has an alias: one join links all of it."""
    state = resolution_state(spark, d, views.event_lines)
    names = resolve.unresolved_counts(state.transactions)
    aliases = names.select("user_id", F.col("scrubbed").alias("scrubbed_pattern"),
                           F.concat(F.lit("M "), "scrubbed").alias("merchant"),
                           F.lit("human").alias("resolved_by"),
                           F.lit(None).cast("double").alias("confidence"))
    after, _ = resolve.resolve(state._replace(aliases=aliases))
    return (after.transactions.groupBy("user_id", "merchant")
            .agg(F.count("*").alias("charges")))


def unresolved_descriptors(spark, d):
    return resolve.unresolved_counts(resolution_state(spark, d).transactions)


def review_decisions(spark, d):
    """Answers to pending items re-point every charge of the descriptor."""
    txns = order_txns(spark, d).withColumn("scrubbed", F.col("raw_descriptor")).withColumn(
        "merchant", F.when(F.col("amount_cents") % 2 == 0, F.lit("OLD"))).withColumn(
        "dedup_hash", F.concat_ws("|", "posted_date", "amount_cents"))
    queue = review_items(spark, d)
    c = views.read(spark, d, "customer", "c_custkey", "c_mktsegment")
    answers = queue.select("user_id", "scrubbed").join(
        c.withColumnRenamed("c_custkey", "user_id"), "user_id")
    def answer(name, ignore, day):
        return answers.select("user_id", "scrubbed", name.alias("merchant"),
                              ignore.alias("ignore"),
                              F.lit(dt.datetime(2026, 1, day)).alias("decided_at"))
    decisions = answer(F.lit("FIRST ANSWER"), F.lit(False), 1).unionByName(
        answer(F.when(F.col("user_id") % 4 > 0, F.concat(F.lit(" "), "c_mktsegment")),
               F.col("user_id") % 4 == 3, 2))
    state = resolve.State(txns, spark.createDataFrame([], schemas.MERCHANT),
                          spark.createDataFrame([], schemas.MERCHANT_ALIAS), queue)
    after = resolve.apply_decisions(state, decisions)
    return (after.transactions.groupBy("user_id", "scrubbed", "merchant")
            .agg(F.count("*").alias("charges"))
            .join(after.queue.select("user_id", "scrubbed", "status"), resolve.NEEDLE))


# ----------------------------------------------------------------- series --
def charge_points(spark, d):
    return series.charge_points(part_txns(spark, d).unionByName(event_txns(spark, d)))


def as_of_dates(spark, d):
    return series.as_of_dates(order_txns(spark, d))


def part_cadences(spark, d):
    c = series.cadences(series.charge_points(part_txns(spark, d)))
    return c.withColumn("norm_dev", F.round("norm_dev", 6))


def event_cadences(spark, d):
    c = series.cadences(series.charge_points(event_txns(spark, d)))
    return c.withColumn("norm_dev", F.round("norm_dev", 6))


def order_cadences(spark, d):
    c = series.cadences(series.charge_points(order_txns(spark, d)))
    return c.withColumn("norm_dev", F.round("norm_dev", 6))


def day_anchors(spark, d):
    return series.day_anchors(series.charge_points(part_txns(spark, d)))


def current_amounts(spark, d):
    return series.current_amounts(series.charge_points(
        part_txns(spark, d).unionByName(event_txns(spark, d))))


def robust_cv(spark, d):
    cv = series.spread(materialise(series.charge_points(order_txns(spark, d))), SERIES)
    return cv.withColumn("cv", F.round("cv", 6))


def plain_subscriptions(spark, d):
    return subscriptions_plain(part_txns(spark, d))


def price_steps(spark, d):
    levels = series.price_levels(series.charge_points(part_txns(spark, d)))
    return series.price_steps(levels)


def segmented_cv(spark, d):
    cv = series.segmented_cv(materialise(series.price_levels(
        series.charge_points(part_txns(spark, d)))))
    return cv.withColumn("cv", F.round("cv", 6))


def subscriptions(spark, d):
    return detected(spark, d)[1]


def event_subscriptions(spark, d):
    return detect(event_txns(spark, d))[0]


def price_changes(spark, d):
    return detected(spark, d)[2]


# ---------------------------------------------------------------- reports --
def spending_by_currency(spark, d):
    _, subs, changes, as_of = detected(spark, d)
    return reports.summary(subs, changes, as_of, review_items(spark, d))


def spending_summary(spark, d):
    _, subs, changes, as_of = detected(spark, d)
    s = reports.spending_summary(subs, changes, as_of, review_items(spark, d))
    return s.select(*(F.round(c, 3).alias(c) if t == "double" else F.col(c)
                      for c, t in s.dtypes))


def subscription_list(spark, d):
    return reports.subscription_list(detected(spark, d)[1]).select(
        *SERIES, "position", "annual_cents", "usage_based", "minor_digits")


def subscription_page(spark, d):
    """Paging: ten of each tenant's list, from the fourth on."""
    return reports.subscription_list(detected(spark, d)[1], 10, 3).select(
        *SERIES, "position", "annual_cents", "usage_based", "minor_digits")


def filtered_subscriptions(spark, d):
    return reports.filtered_list(detected(spark, d)[1], "active", 5000).select(
        *SERIES, "annual_cents", "status")


def upcoming_charges(spark, d):
    _, subs, _, as_of = detected(spark, d)
    return reports.upcoming(subs, as_of, 45)


def upcoming_totals(spark, d):
    _, subs, _, as_of = detected(spark, d)
    return reports.upcoming_totals(reports.upcoming(subs, as_of, 400))


def price_increases(spark, d):
    _, subs, changes, _ = detected(spark, d)
    return reports.price_increases(changes, subs).drop("period_days", "pct_change")


def charge_history(spark, d):
    txns = part_txns(spark, d)
    return reports.history(txns, subscriptions_plain(txns))


def review_queue(spark, d):
    return reports.review_queue(review_items(spark, d)).drop("candidates")


def forgotten_subscriptions(spark, d):
    return reports.forgotten(detected(spark, d)[1])


def data_quality(spark, d):
    txns = order_txns(spark, d).withColumn("merchant", F.when(
        F.col("amount_cents") % 3 != 0, F.col("scrubbed")))
    merchants = txns.filter("merchant is not null").select(
        "user_id", F.col("merchant").alias("canonical_name")).distinct()
    return reports.data_quality(txns, merchants, review_items(spark, d))


def frequent_merchants(spark, d):
    return reports.frequent_merchants(event_txns(spark, d).unionByName(part_txns(spark, d)))


def variant_groups(spark, d):
    """Merchants named by their first word."""
    txns = part_txns(spark, d)
    return reports.variant_groups(txns.withColumn(
        "merchant", F.substring_index("scrubbed", " ", 1)))


def understated_totals(spark, d):
    return reports.understatement(review_items(spark, d))


def detected_totals(spark, d):
    return reports.detected_totals(detected(spark, d)[1])


def cost_shares(spark, d):
    s = reports.cost_shares(detected(spark, d)[1])
    return s.withColumn("cost_share", F.round("cost_share", 6))


def displayed_amounts(spark, d):
    return reports.displayed(detected(spark, d)[1])


def mixed_currency_series(spark, d):
    return reports.mixed_currency_series(part_txns(spark, d))


def load_report(spark, d):
    typed = materialise(statements.typed_lines(statement_fields(spark, d)))
    facts = materialise(statements.file_facts(typed))
    new = load.new_transactions(statements.signed_lines(typed, facts))
    _, outcomes = resolve.resolve(resolution_state(spark, d, views.event_lines))
    return reports.load_report(facts, new, outcomes, detected(spark, d)[1])


#: Of each named report: what a row is about, its amount, day and note.
SHOWN = {
    "list_subscriptions": ("annual_cents", "next_due", "cadence"),
    "spending_summary": ("annual", "statement_through", "active_subscriptions"),
    "upcoming_charges": ("current_amount_cents", "next_due", "currency"),
    "price_increases": ("annual_impact_cents", "effective_date", "position"),
    "find_forgotten": ("current_amount_cents", "last_seen", "reason"),
    "data_quality": ("resolved_pct", None, "merchants")}


def named_reports(spark, d):
    """Every named report of every tenant, all rows."""
    txns, subs, changes, as_of = detected(spark, d, materialise(part_txns(spark, d)))
    tables = {"raw_transaction": txns, "subscription": materialise(subs),
              "price_change": materialise(changes), "as_of": as_of,
              "merchant": txns.select("user_id", F.col("merchant").alias("canonical_name"))
              .distinct(), "resolution_queue": review_items(spark, d)}
    out = None
    for name, (amount, day, note) in SHOWN.items():
        rows = reports.call_for_all(tables, name, {"days": 9999, "user_id": 4})
        item = (F.concat_ws("|", "merchant", "account_id") if "merchant" in rows.columns
                and "account_id" in rows.columns else F.col("currency")
                if "currency" in rows.columns else F.lit(None).cast("string"))
        rows = rows.select(
            F.lit(name).alias("report"), "user_id", item.alias("item"),
            F.round(F.col(amount).cast("double"), 3).alias("amount"),
            (F.col(day) if day else F.lit(None).cast("date")).alias("day"),
            F.col(note).cast("string").alias("note"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ----------------------------------------------------- quality, attempts --
def _truth(spark, d):
    """What each part merchant should be, by how its lines were made. Only
    merchants behind one part on one account have one true cadence."""
    p = views.read(spark, d, "part", "p_partkey", "p_name", "p_type")
    k = F.col("p_partkey")
    cadence = F.element_at(F.array(*(F.lit(c) for c in (
        "weekly", "biweekly", "semimonthly", "monthly", "quarterly", "semiannual", "annual"))),
        (k % 7 + 1).cast("int"))
    return (p.groupBy((F.floor(k / views.PARTS_PER_TENANT) + 1).alias("user_id"),
                      F.concat(F.upper("p_name"), F.lit(" "), "p_type").alias("merchant"))
            .agg(F.count("*").alias("_n"), F.min(cadence).alias("_c"))
            .select("user_id", "merchant", F.when(F.col("_n") == 1, F.col("_c"))
                    .alias("expected")))


def detector_scores(spark, d):
    judged = evaluation.judgements(_truth(spark, d), subscriptions_plain(part_txns(spark, d)))
    s = evaluation.scores(judged)
    return s.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c)
                      for c, t in s.dtypes))


def detector_errors(spark, d):
    return evaluation.errors(evaluation.judgements(
        _truth(spark, d), subscriptions_plain(part_txns(spark, d))))


def pattern_truth(spark, d):
    """Labels by the first pattern found in a name."""
    patterns = (("^RED", "weekly"), ("RING", "monthly"), ("^COLD .*SMALL$", "annual"),
                ("SMALL", "quarterly"))
    merchants = part_txns(spark, d).select("user_id", "merchant").distinct()
    return evaluation.expected_by_pattern(merchants, patterns)


def trailing_attempts(spark, d):
    return attempts.trailing_rate(attempt_log(spark, d), LIMITS).select(
        "kind", "key", "event_id", "recent", "flagged")


def accepted_attempts(spark, d):
    return attempts.replay(attempt_log(spark, d), LIMITS).select(
        "kind", "key", "event_id", "accepted")


QUERIES = {f.__name__: f for f in (
    scrub_descriptors, parsed_amounts, parsed_dates, money_columns, dedup_keys,
    statement_lines, split_statement_lines, statement_files, rejected_files,
    signed_statement_lines,
    sign_conventions,
    idempotent_load, reload_is_noop, account_upsert, merged_keep_first, queue_upsert,
    tenant_rows, no_tenant_rows, erased_tables, purged_attempts, replaced_derived,
    backfilled_currency, name_similarity, unresolved_descriptors, exact_tier, founders,
    resolution_outcomes, resolution_tiers, resolved_transactions, resolved_aliases,
    queued_candidates,
    review_decisions, charge_points, as_of_dates, part_cadences, event_cadences,
    order_cadences, day_anchors, current_amounts, robust_cv, plain_subscriptions,
    price_steps, segmented_cv, subscriptions, event_subscriptions, price_changes,
    spending_by_currency, spending_summary, subscription_list, subscription_page,
    filtered_subscriptions,
    upcoming_charges, upcoming_totals, price_increases, charge_history, review_queue,
    forgotten_subscriptions, data_quality, frequent_merchants, variant_groups,
    understated_totals, detected_totals, cost_shares, displayed_amounts,
    mixed_currency_series, load_report, named_reports, detector_scores, detector_errors,
    pattern_truth, trailing_attempts, accepted_attempts)}
