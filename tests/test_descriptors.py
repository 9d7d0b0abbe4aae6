"""Golden tables for the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duebook.functions.dates import parse_date
from duebook.functions.descriptors import scrub
from duebook.functions.money import (annualise, format_minor, minor_digits, parse_amount,
                                     to_minor)

# Published descriptor cases: raw text and the merchant string expected of it.
DESCRIPTORS = {
    "SP * NETFLIX.COM 866-579-7172": "NETFLIX",
    "NETFLIX.COM": "NETFLIX",
    "Netflix 1 800 associates": "NETFLIX ASSOCIATES",
    "SQ *BLUE BOTTLE COFFEE": "BLUE BOTTLE COFFEE",
    "TST* BLUE BOTTLE 0091 OAKLAND CA": "BLUE BOTTLE OAKLAND",
    "PAYPAL *SPOTIFY USA": "SPOTIFY",
    "POS DEBIT SQ *PHILZ COFFEE": "PHILZ COFFEE",
    "CHECKCARD 0803 ADOBE SYSTEMS 408-536-6000 CA": "ADOBE SYSTEMS",
    "PURCHASE AUTHORIZED ON 08/03 AMZN MKTP US*2K4LM SEATTLE WA": "AMZN MKTP US SEATTLE",
    "SPOTIFY USA #4429": "SPOTIFY",
    "GITHUB.COM REF#88213": "GITHUB",
    "CLAUDE.AI SUBSCRIPTION 000123456789": "CLAUDE AI SUBSCRIPTION",
    "7 ELEVEN 33812 FREMONT CA": "7 ELEVEN FREMONT",
    "24 HOUR FITNESS 0421": "24 HOUR FITNESS",
    "CA": "CA",
    "AT&T *PAYMENT 800-288-2020 TX": "AT T PAYMENT",
    "メルカリ": "メルカリ",
    "Аптека Ригла": "АПТЕКА РИГЛА",
    "नेटफ्लिक्स": "नेटफ्लिक्स",
    "支付宝-网易云音乐": "支付宝 网易云音乐",
    # worked out by hand
    "": "",
    "   ": "",
    "123456 #77": "",
    "ACME ① 9 SHOP": "ACME SHOP",
    "PP*SP*DD*1800FLOWERS ORDER A1B2C3 XX99": "1800FLOWERS ORDER",
    "RECURRING CARD PURCHASE  WEB ID: 77 GYM 12/31 USA": "GYM",
    "ACME CORP\tNY": "ACME CORP",
    "FOO.COMPANY": "FOO COMPANY",
    "ACME AUTH: Z9 INV 12 #8": "ACME",
}

AMOUNTS = [
    ("$1,234.56", "USD", 123456), ("1.234,56", "USD", 123456), ("1 234,56", "USD", 123456),
    ("£45.99", "USD", 4599), ("₹1,299.00", "USD", 129900), ("(45.00)", "USD", -4500),
    ("-1.234,56", "USD", -123456), ("1,50", "USD", 150), ("1,500", "USD", 150000),
    ("45.99", "USD", 4599), ("", "USD", None), ("--", "USD", None),
    ("15.49", "USD", 1549), ("1,234.56", "USD", 123456), ("1.234", "USD", 123400),
    ("1200", "JPY", 1200), ("1,200", "JPY", 1200), ("12.00", "JPY", 12),
    ("1,234,567", "JPY", 1234567), ("1.234", "KWD", 1234), ("1.234,56", "EUR", 123456),
    ("(45.00)", "USD", -4500),
    # worked out by hand
    ("1.234.56", "USD", None), ("1 234,56", "USD", None), ("−45.00", "USD", 4500),
    ("1,234.5", "JPY", 1234), ("12.", "USD", 1200), (".5", "USD", 50), (".", "USD", None),
    (None, "USD", None), ("1,234,567.89", "USD", 123456789), ("٤٥.٩٩", "USD", 4599),
    ("0.125", "KWD", 125), ("2.5", "JPY", 25), ("45 CR", None, 4500), ("1e5", "USD", 1500),
]

DATES = [
    ("08/03/2025", False, "2025-08-03"), ("8/3/25", False, "2025-08-03"),
    ("2025-08-03", False, "2025-08-03"), ("08-03-2025", False, "2025-08-03"),
    ("2025/08/03", False, "2025-08-03"), ("03-SEP-2025", False, "2025-09-03"),
    ("Sep 3, 2025", False, "2025-09-03"), ("3 sep 2025", False, "2025-09-03"),
    ("03.09.2025", False, "2025-09-03"), ("03/09/2025", True, "2025-09-03"),
    ("03/09/25", True, "2025-09-03"), ("03-09-2025", True, "2025-09-03"),
    ("03.09.25", True, "2025-09-03"), ("3-Sep-2025", True, "2025-09-03"),
    ("2025-09-03", True, "2025-09-03"), ("2025/9/3", True, "2025-09-03"),
    ("1/1/68", False, "2068-01-01"), ("1/1/69", False, "1969-01-01"),
    ("02/30/2025", False, None), ("13/01/2025", False, None), ("2025", False, None),
    ("2025-01-02T00:00", False, None), ("", False, None), (None, True, None),
    ("Sep 3, 2025", True, None), ("03.09.25", False, None), ("3 Foo 2025", False, None),
    ("0000-01-01", False, None), (" 01/ 5/2025 ", False, "2025-01-05"),
    ("3 Ars 2025", False, None),
]


@pytest.mark.parametrize("again", [False, True])
def test_scrub(spark, again):
    df = spark.createDataFrame([(k, v) for k, v in DESCRIPTORS.items()], "raw string, want string")
    got = df.select("raw", "want", scrub(F.col("want" if again else "raw")).alias("got"))
    assert [tuple(r) for r in got.filter("got <> want").collect()] == []


def test_amounts(spark):
    df = spark.createDataFrame(AMOUNTS, "raw string, currency string, want long")
    got = df.withColumn("got", parse_amount(F.col("raw"), F.col("currency")))
    assert [tuple(r) for r in got.filter("not (got <=> want)").collect()] == []


def test_dates(spark):
    df = spark.createDataFrame(DATES, "raw string, dayfirst boolean, want string")
    got = df.withColumn("got", parse_date(F.col("raw"), F.col("dayfirst")).cast("string"))
    assert [tuple(r) for r in got.filter("not (got <=> want)").collect()] == []
    fixed = spark.createDataFrame([("03/09/2025",)], "raw string").select(
        parse_date(F.col("raw"), True), parse_date(F.col("raw"), False)).first()
    assert tuple(fixed) == (dt.date(2025, 9, 3), dt.date(2025, 3, 9))


def test_money(spark):
    df = spark.createDataFrame(
        [("USD", 2), ("jpy", 0), ("KWD", 3), ("", 2), (None, 2)], "c string, want int")
    assert df.filter(minor_digits(F.col("c")) != F.col("want")).count() == 0
    row = spark.range(1).select(
        to_minor(F.lit(15.49), F.lit("USD")), to_minor(F.lit(2.5), F.lit("JPY")),
        to_minor(F.lit(1.234), F.lit("KWD")),
        format_minor(F.lit(123456), F.lit("usd")), format_minor(F.lit(-1200), F.lit("JPY")),
        format_minor(F.lit(1234567), F.lit("KWD")),
        annualise(F.lit(1799), F.lit(30.44))).first()
    assert tuple(row) == (1549, 2, 1234, "1,234.56 USD", "-1,200 JPY", "1,234.567 KWD", 21586)


def test_trailing_rounds_against_a_loop(spark):
    """Plain text: as many rounds as there is junk, and none of them only to look."""
    import re

    from duebook.functions import descriptors as d

    def loop(text):
        while True:
            before = text
            for i, pattern in enumerate(d.TRAILING_JUNK):
                text = re.sub(pattern.replace(d.WORD, "[A-Za-z0-9_]"), "", text)
                text = text.strip(d._BLANKS) if i == 0 else text
            if re.search(r"\S\s+(?:" + "|".join(d.STATE_CODES) + ")$", text):
                text = re.sub(r"\s+(?:" + "|".join(d.STATE_CODES) + ")$", "", text)
            if text == before:
                return text

    junk = [" 866-579-7172", " 12345678", " #A17", " 12/31", " USA", " CA", " XX12", " REF:9", "  NY"]
    texts = ["X", "X Y", "MIDNIGHT CO", "A #", "X" + " US" * 40, "CA CA", " CA", "12/31 USA"]
    texts += ["SHOP" + "".join(junk[k * i % len(junk)] for i in range(1, n))
              for k in range(1, 9) for n in range(1, 14)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", d.peel_trailing(F.col("t"), True).alias("got"))
    assert {r.t: r.got for r in rows.collect()} == {t: loop(t) for t in texts}
    shown = rows._jdf.queryExecution().analyzed().toString()
    assert "/ cast(2" not in shown and "translate(" in shown     # bounded by blanks
