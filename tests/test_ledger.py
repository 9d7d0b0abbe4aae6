"""End to end: files of several tenants, loaded, reloaded, answered, erased."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duebook.operators import tenancy
from duebook.plans import ledger, reports
from duebook.sources import statements, store
from duebook.streaming import statement_drop

US = """Date,Description,Amount
09/03/2025,SP * NETFLIX.COM 866-579-7172,-15.49
10/03/2025,NETFLIX.COM,-15.49
11/03/2025,NETFLIX.COM,-15.49
12/03/2025,SP * NETFLIX.COM 866-579-7172,-17.99
01/03/2026,NETFLIX.COM,-17.99
02/03/2026,NETFLIX.COM,-17.99
09/14/2025,ALICE THERAPY ASSOCIATES,-180.00
""".encode()
EU = """Datum;Beschreibung;Betrag
03.09.2025;SPOTIFY AB;-11,99
03.10.2025;SPOTIFY AB;-11,99
03.11.2025;SPOTIFY AB;-11,99
03.12.2025;SPOTIFY AB;-11,99
14.09.2025;BOB PRIVATE CLINIC;-250,00
""".encode()
JP = b"Date,Description,Amount\n" + b"".join(
    b"%02d/09/2026,SPOTIFY JP,-1200\n" % m for m in range(1, 7))
PAIR = ("Transaction Date,Post Date,Description,Running Balance Amount,Withdrawal,Deposit\n"
        "01/01/2026,01/02/2026,CAFÉ RIO,9.00,4.50,\n"
        "01/03/2026,01/04/2026,PAYDAY,9.00,,100.00\n"
        "01/05/2026,01/06/2026,NOTHING,9.00,0.00,\n"
        ",,TOTAL,9.00,,\n").encode("cp1252")
POSITIVE = b"Date|Payee|Value\n2026-01-02|GYM|30.00\n2026-02-02|GYM|30.00\n2026-02-03|BACK|-5.00\n" \
           b"2026-03-02|GYM|30.00\n"
T0 = dt.datetime(2026, 1, 1)
ALICE, BOB, CARL = 1, 2, 3
FILES = {
    "user_id=1/account=alice-card/a.csv": US,
    "user_id=2/account=bob-card/currency=EUR/dayfirst=true/b.csv": EU,
    "user_id=3/account=c/pair.csv": PAIR,
    "user_id=3/account=c/positive.TXT": POSITIVE,
    "user_id=3/account=c/empty.csv": b"",
    "user_id=3/account=c/binary.csv": b"\x00\x01\x02binary",
    "user_id=3/account=c/columns.csv": b"no,useful,columns\n1,2,3",
    "user_id=3/account=c/picture.png": b"x",
    "user_id=3/account=c/undecodable.csv": b"\x81\x8d",
    "user_id=3/account=ghost/header.csv": b"Date,Description,Amount\n",
    "account=c/orphan.csv": US,
    "user_id=3/account=ghost/currency=EURO/euro.csv": US,
    "user_id=3/account=c/summary.csv": b"Date,Description,Amount\n,,\n",
}


def frame(spark, files):
    rows = [(f"file:/drop/{p}", T0, len(c), c) for p, c in files.items()]
    return statements.describe_files(spark.createDataFrame(rows, statement_drop.BINARY_FILE))


@pytest.fixture(scope="module")
def loaded(spark):
    return ledger.load_files(store.empty_tables(spark), frame(spark, FILES), T0)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_load_report_and_rejects(loaded):
    got = {r.source_file.rsplit("/", 1)[1]: r for r in loaded.report.collect()}
    assert set(got) == {"a.csv", "b.csv", "pair.csv", "positive.TXT"}
    assert (got["a.csv"].rows_read, got["a.csv"].rows_new, got["a.csv"].rows_duplicate) == (7, 7, 0)
    assert got["b.csv"].rows_read == 5 and got["b.csv"].subscriptions_found == 1
    assert (got["pair.csv"].rows_read, got["pair.csv"].rows_skipped) == (2, 2)
    assert got["positive.TXT"].sign_flipped and not got["a.csv"].sign_flipped
    why = {r.source_file.rsplit("/", 1)[1]: r.reason for r in loaded.rejects.collect()}
    assert why == {"empty.csv": "empty", "binary.csv": "binary", "undecodable.csv": "not text",
                   "columns.csv": "no date or description column",
                   "picture.png": "not a .csv, .txt or .tsv file",
                   "summary.csv": "no usable rows", "header.csv": "no usable rows",
                   "orphan.csv": "no user", "euro.csv": "currency is not three letters"}
    accounts = {(r.user_id, r.label) for r in loaded.tables["account"].collect()}
    assert accounts == {(1, "alice-card"), (2, "bob-card"), (3, "c")}


def test_lines(loaded):
    t = loaded.tables["raw_transaction"].filter("user_id = 3")
    assert rows(t, F.col("posted_date").cast("string"), "amount_cents", "raw_descriptor") == [
        ("2026-01-02", -3000, "GYM"), ("2026-01-02", -450, "CAFÉ RIO"),
        ("2026-01-04", 10000, "PAYDAY"), ("2026-02-02", -3000, "GYM"),
        ("2026-02-03", 500, "BACK"), ("2026-03-02", -3000, "GYM")]


def test_subscriptions(loaded):
    s = {(r.user_id, r.merchant): r for r in loaded.tables["subscription"].collect()}
    n = s[ALICE, "NETFLIX"]
    assert (n.cadence, n.charge_count, n.anchor_day, n.current_amount_cents, n.amount_cv,
            n.confidence, n.status, n.next_due) == (
        "monthly", 6, 3, 1799, 0.0, 1.0, "active", dt.date(2026, 3, 3))
    b = s[BOB, "SPOTIFY AB"]
    assert (b.cadence, b.charge_count, b.confidence, b.next_due, b.current_amount_cents,
            b.currency) == ("monthly", 4, 0.888, dt.date(2026, 1, 3), 1199, "EUR")
    assert rows(loaded.tables["price_change"], "user_id", "merchant",
                F.col("effective_date").cast("string"), "old_amount_cents", "new_amount_cents",
                "pct_change") == [(ALICE, "NETFLIX", "2025-12-03", 1549, 1799, 16.14)]


def test_reports(loaded):
    t = ledger.with_as_of(loaded.tables)
    total = {r.user_id: r for r in reports.summary(
        t["subscription"], t["price_change"], t["as_of"], t["resolution_queue"]).collect()}
    assert (total[ALICE].annual_minor, total[ALICE].price_increase_annual_minor,
            total[ALICE].active_count) == (21586, 3000, 1)
    assert (total[BOB].annual_minor, total[BOB].currency) == (14387, "EUR")
    first = reports.call(t, ALICE, "list_subscriptions").first()
    assert first.current_amount_cents == 1799
    assert reports.call(t, ALICE, "list_subscriptions", {"min_annual": 99999}).count() == 0
    with pytest.raises(ValueError):
        reports.upcoming(t["subscription"], t["as_of"], 0)
    assert reports.call(t, ALICE, "upcoming_charges", {"days": 400, "user_id": BOB}).first(
    ).merchant == "NETFLIX"
    up = reports.call(t, ALICE, "price_increases").first()
    assert (up.old_amount_cents, up.new_amount_cents, up.annual_impact_cents) == (1549, 1799, 3000)
    q = reports.call(t, ALICE, "data_quality").first()
    assert (q.transactions, q.resolved_to_a_merchant, q.resolved_pct) == (7, 7, 100.0)
    s = reports.call(t, ALICE, "spending_summary", {"limit": 1}).first()
    assert (s.active_subscriptions, s.annual) == (1, 215.86)
    with pytest.raises(KeyError):
        reports.call(t, ALICE, "no_such_report")
    assert reports.call(t, None, "list_subscriptions").count() == 0
    h = reports.history(t["raw_transaction"], t["subscription"]).filter("user_id = 1")
    assert [r.amount_cents for r in h.orderBy("position").collect()] == [1549] * 3 + [1799] * 3
    shown = reports.displayed(t["subscription"]).filter("user_id = 2").first()
    assert (shown.amount, shown.per_year) == ("11.99 EUR", "143.87 EUR")


def test_reload_rename_other_currency(spark, loaded):
    again = ledger.load_files(loaded.tables, frame(spark, {
        "user_id=1/account=alice-card/again.csv": US}), T0 + dt.timedelta(days=1))
    assert again.report.first().rows_new == 0
    assert again.tables["raw_transaction"].count() == 18
    jp = "user_id=1/account=alice-jp/currency=JPY/jp.csv"
    third = ledger.load_files(loaded.tables, frame(spark, {jp: JP}), T0)
    s = third.tables["subscription"].filter("merchant like 'SPOTIFY%' and user_id = 1").first()
    assert (s.current_amount_cents, s.currency) == (1200, "JPY")
    # as_of moved on for this tenant, so the other series went silent; Bob's did not change.
    assert third.tables["subscription"].filter("merchant = 'NETFLIX'").first().status == "cancelled"
    keep = [c for c in store.SCHEMAS["subscription"].split(", ")]
    names = [c.split()[0] for c in keep]
    assert rows(third.tables["subscription"].filter("user_id = 2"), *names) == rows(
        loaded.tables["subscription"].filter("user_id = 2"), *names)
    renamed = {**third.tables, "account": third.tables["account"].withColumn("label", F.when(
        F.col("label") == "alice-jp", "renamed").otherwise(F.col("label")))}
    fourth = ledger.load_files(renamed, frame(spark, {
        "user_id=1/account=renamed/currency=JPY/jp.csv": JP}), T0 + dt.timedelta(days=2))
    assert fourth.report.first().rows_new == 0
    assert fourth.tables["account"].filter("user_id = 1").count() == 2


def test_replay_after_a_crash(spark, loaded):
    """Charges are there but what follows from them was never written."""
    broken = {**store.empty_tables(spark), "account": loaded.tables["account"],
              "raw_transaction": loaded.tables["raw_transaction"].withColumn(
                  "merchant", F.lit(None).cast("string"))}
    again = ledger.load_files(broken, frame(spark, FILES), T0 + dt.timedelta(days=1))
    assert {r.rows_new for r in again.report.collect()} == {0}
    for name in ("subscription", "price_change", "merchant", "raw_transaction"):
        columns = [c.split()[0] for c in store.SCHEMAS[name].split(", ")
                   if not c.startswith("category")]
        assert rows(again.tables[name], *columns) == rows(loaded.tables[name], *columns)


def test_all_price_changes_and_idle_tenants(spark):
    day = dt.date(2020, 1, 1)
    changes = spark.createDataFrame(
        [(1, "A", 1, day + dt.timedelta(days=i), 100, 200, 100.0) for i in range(600)],
        store.SCHEMAS["price_change"])
    subs = spark.createDataFrame([(1, "A", 1, "monthly", 30.44, "USD")],
                                 "user_id long, merchant string, account_id long, "
                                 "cadence string, period_days double, currency string")
    assert reports.price_increases(changes, subs).count() == 600
    assert reports.price_increases(changes, subs, 550, 40).count() == 550
    none = store.empty_tables(spark)
    as_of = spark.createDataFrame([(7, day)], "user_id long, as_of date")
    queue = spark.createDataFrame([(7, "X", 1, None, None, "unknown", "pending"),
                                   (8, "Y", 1, None, None, "unknown", "pending")],
                                  store.SCHEMAS["resolution_queue"])
    got = reports.summary(none["subscription"], none["price_change"], as_of, queue)
    assert rows(got, "user_id", "annual_minor", "awaiting_review") == [(7, 0, 1), (8, 0, 1)]


def test_isolation_and_erasure(spark, loaded):
    alone = ledger.load_files(store.empty_tables(spark), frame(spark, {
        p: c for p, c in FILES.items() if p.startswith("user_id=1/")}), T0).tables
    gone = tenancy.erase(loaded.tables, spark.createDataFrame([(BOB,), (CARL,)], "user_id long"))
    for name in ("merchant", "merchant_alias", "raw_transaction", "resolution_queue",
                 "subscription", "price_change"):
        columns = [c.split()[0] for c in store.SCHEMAS[name].split(", ")
                   if not c.startswith(("candidates", "category"))]
        mine = rows(tenancy.for_tenant(loaded.tables[name], ALICE), *columns)
        assert mine == rows(alone[name], *columns) == rows(gone[name], *columns)
        assert tenancy.for_tenant(loaded.tables[name], None).count() == 0


def test_review_answer(spark, loaded):
    more = "Date,Description,Amount\n03/03/2026,NETFLIKS,-17.99\n".encode()
    t = ledger.load_files(loaded.tables, frame(spark, {
        "user_id=1/account=alice-card/more.csv": more}), T0).tables
    q = reports.review_queue(t["resolution_queue"]).first()
    assert (q.scrubbed, q.reason, q.candidates[0].name, q.top_score) == (
        "NETFLIKS", "borderline", "NETFLIX", 80.0)
    assert tuple(reports.understatement(t["resolution_queue"]).first()) == (ALICE, 1, 1)
    done = ledger.answer_review(t, spark.createDataFrame(
        [(ALICE, "NETFLIKS", "NETFLIX", False, T0)],
        "user_id long, scrubbed string, merchant string, ignore boolean, decided_at timestamp"))
    s = done["subscription"].filter("merchant = 'NETFLIX'").first()
    assert s.charge_count == 7 and s.next_due == dt.date(2026, 4, 3)
    assert done["subscription"].filter("user_id = 2").count() == 1
    groups = reports.variant_groups(done["raw_transaction"])
    assert rows(groups, "merchant", "scrubbed", "variants", "charges") == [
        ("NETFLIX", "NETFLIKS", 2, 7), ("NETFLIX", "NETFLIX", 2, 7)]


def test_drop_stream(spark, tmp_path):
    drop, root = tmp_path / "drop", str(tmp_path / "tables")

    def put(path, content):
        f = drop / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content)

    def run():
        q = statement_drop.start(spark, str(drop), root, str(tmp_path / "ck"))
        q.awaitTermination()

    put("user_id=1/account=alice-card/a.csv", US)
    run()
    put("user_id=2/account=bob-card/currency=EUR/dayfirst=true/b.csv", EU)
    put("user_id=1/account=alice-card/copy.csv", US)
    run()
    t = store.read_tables(spark, root)
    assert t["raw_transaction"].count() == 12
    assert rows(t["subscription"], "user_id", "merchant", "current_amount_cents") == [
        (1, "NETFLIX", 1799), (2, "SPOTIFY AB", 1199)]


def test_export_and_purge(spark, loaded, tmp_path):
    tenancy.export_tables(loaded.tables, str(tmp_path / "one"), ALICE)
    assert spark.read.json(str(tmp_path / "one" / "raw_transaction")).count() == 7
    tenancy.export_tables(loaded.tables, str(tmp_path / "all"), everyone=True)
    assert spark.read.json(str(tmp_path / "all" / "raw_transaction")).count() == 18
    log = spark.createDataFrame([("login", "a", T0), ("login", "a", T0 + dt.timedelta(days=3))],
                                "kind string, key string, at timestamp")
    assert tenancy.purge_older(log, "at", T0 + dt.timedelta(days=3)).count() == 1
    assert tenancy.purge_expired(log, "at", T0 + dt.timedelta(days=1)).count() == 1
    bare = loaded.tables["subscription"].withColumn("currency", F.lit(None).cast("string"))
    fixed = tenancy.backfill_currency(bare, loaded.tables["raw_transaction"])
    assert rows(fixed, "user_id", "currency") == rows(
        loaded.tables["subscription"], "user_id", "currency")
