"""From statement files to subscriptions, for every tenant the files belong to."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.operators.load import FILE, new_transactions, upsert_accounts
from duebook.operators.resolve import State, apply_decisions, resolve
from duebook.operators.series import as_of_dates
from duebook.operators.skew import LIST_ROWS, KeyList, key_list, materialise, per_key_join
from duebook.operators.subscriptions import detect
from duebook.operators.tenancy import only_tenants, replace_derived
from duebook.plans import reports
from duebook.sources import splits, statements

RESOLUTION = ("raw_transaction", "merchant", "merchant_alias", "resolution_queue")


class Loaded(NamedTuple):
    tables: dict[str, DataFrame]
    report: DataFrame
    rejects: DataFrame


def _analyse(tables: dict[str, DataFrame], affected: KeyList):
    """Resolve and detect for the affected tenants -> (tables, outcomes, subs)."""
    mine = {name: only_tenants(df, affected) for name, df in tables.items()}
    state, outcomes = resolve(State(*(mine[n] for n in RESOLUTION)))
    txns = materialise(state.transactions)
    subs, changes = detect(txns)
    subs = materialise(subs)
    new = dict(zip(RESOLUTION, state._replace(transactions=txns)))
    new |= {"subscription": subs, "price_change": changes}
    return ({**tables, **{name: replace_derived(tables[name], df, affected)
                          for name, df in new.items()}}, outcomes, subs)


def load_files(tables: dict[str, DataFrame], files: DataFrame, loaded_at: dt.datetime,
               root: str | list[str] | None = None) -> Loaded:
    """Load statement files (see ``statements.describe_files``), which lie below `root`, or
    are the paths it lists, or have their content in a column: decode, parse, drop what is
    already there, resolve, detect. Loading a file twice adds nothing the second time, but
    resolves and detects again for the tenants of all accepted files, so a load that broke
    off before its results were written is made good. Accounts come from accepted files
    only."""
    readable = statements.readable_files(files)
    label = ["user_id", "label"]
    uploads = readable.select(*label, "currency", "source_file")
    known = upsert_accounts(tables["account"], uploads.drop("source_file"), loaded_at)
    known = materialise(known.join(uploads.select(*label).distinct(), label, "left_semi")
                        .select(*label, "account_id"))
    # Files are shuffled only where the labels are too many to be sent along.
    opened = (readable.join(F.broadcast(known), label) if known.count() <= LIST_ROWS
              else per_key_join(readable, known, label, ["source_file"]))
    fields = materialise(statements.split_files(opened) if root is None
                         else splits.read_fields(opened, root))
    typed = materialise(statements.typed_lines(fields))
    facts = materialise(statements.file_facts(typed))
    accepted = facts.filter("reason is null").select(*FILE)
    accounts = materialise(upsert_accounts(
        tables["account"], uploads.join(accepted, FILE, "left_semi").drop("source_file"),
        loaded_at))
    lines = materialise(statements.signed_lines(typed, facts))
    # A charge loaded before has its date, so older and newer history is not read.
    first, last = lines.agg(F.min("posted_date"), F.max("posted_date")).first()
    known = tables["raw_transaction"].filter(F.col("posted_date").between(
        F.lit(first).cast("date"), F.lit(last).cast("date")))
    new = materialise(new_transactions(lines, known))
    affected = key_list(accepted, ["user_id"])
    tables = {**tables, "account": accounts,
              "raw_transaction": tables["raw_transaction"].unionByName(new)}
    tables, outcomes, subs = _analyse(tables, affected)
    return Loaded(tables, reports.load_report(facts, new, outcomes, subs),
                  statements.rejects(files, fields, facts))


def answer_review(tables: dict[str, DataFrame], decisions: DataFrame) -> dict[str, DataFrame]:
    """Apply review answers, then resolve and detect again for their tenants."""
    state = apply_decisions(State(*(tables[n] for n in RESOLUTION)), decisions)
    tables = {**tables, **dict(zip(RESOLUTION, state))}
    return _analyse(tables, key_list(decisions, ["user_id"]))[0]


def with_as_of(tables: dict[str, DataFrame], today: dt.date | None = None
               ) -> dict[str, DataFrame]:
    """Adds the ``as_of`` table the reports read: the newest transaction of each
    tenant, or `today` for a tenant that only has an account."""
    newest = as_of_dates(tables["raw_transaction"])
    if today is not None:
        known = tables["account"].select("user_id").distinct()
        newest = known.join(newest, "user_id", "left").select(
            "user_id", F.coalesce("as_of", F.lit(today)).alias("as_of"),
            F.coalesce("rows", F.lit(0)).alias("rows"))
    return {**tables, "as_of": newest}
