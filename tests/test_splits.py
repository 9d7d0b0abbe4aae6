"""Files in byte ranges against the csv module over whole files."""

import csv
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from duebook.plans import ledger
from duebook.sources import splits, statements, store

HEADER = ["Posted", "Details", "Amount", "Note"]


def quoted(rng, rows, quote='"', delimiter=","):
    text = io.StringIO()
    out = csv.writer(text, delimiter=delimiter, quotechar=quote, lineterminator="\n")
    out.writerow(HEADER)
    for i in range(rows):
        name = rng.choice(["plain", "with, comma", 'say "hi"', "two\nlines", "it's", "café",
                           'a\n"b"\n\nc', "tab\t|;", 'end"'])
        out.writerow([f"2024-01-{i % 28 + 1:02d}", f"{name} {i}", f"-{i}.50", "x" * (i % 40)])
    return text.getvalue()


def files():
    rng = random.Random(4)
    plain = "\n".join([",".join(HEADER)] + [f"2024-02-{i % 28 + 1:02d},shop {i},-{i}.25,"
                                            for i in range(90)])
    stray = "\n".join(["Date,Payee,Amount"] + [f'2024-01-01,5" pipe {i},-{i}' for i in range(40)])
    long = "Date,Payee,Amount\n2024-01-01,\"" + "line\n" * 400 + "\",-5\n2024-01-02,b,-6\n"
    return {
        "plain.csv": plain.encode(),
        "returns.csv": plain.replace("\n", "\r\n").encode() + b"\r\n",
        "bom.csv": b"\xef\xbb\xbf" + plain.encode(),
        "older.csv": plain.replace("shop", "café €“").encode("cp1252"),
        "late.csv": plain.encode() + "\n2024-03-01,é,-1,".encode("cp1252"),
        "blank.txt": ("\n".join(["Date;Payee;Amount", "", "2024-01-01;a;1", "", " ",
                                 "2024-01-02;b", "2024-01-03;c;3;4;5"])).encode(),
        "quoted.csv": quoted(rng, 130).encode(),
        "single.csv": quoted(rng, 60, "'", ";").encode(),
        "stray.csv": stray.encode(),
        "long.csv": long.encode(),
        "unended.csv": b"Date,Payee,Amount\n2024-01-01,a,1\n2024-01-02,\"b,2\n2024-01-03,c,3\n",
        "empty.csv": b"", "header.csv": b"Date,Payee,Amount\n",
        "binary.csv": b"\x00\x01\x02binary", "undecodable.csv": b"\x81\x8d",
        "columns.csv": b"no,useful,columns\n1,2,3", "old_mac.csv": b"Date,Payee,Amount\r2024-01-01,a,1",
        "spaced.csv": ("Date, Payee, Amount\n" + "2024-01-01, a b, 5\n" * 9).encode(),
        "no_first.csv": b"\nDate,Payee,Amount\n2024-01-01,a,1\n",
        "same.csv": b"Date,Payee,Amount,Amount\n2024-01-01,a,1,2\n" * 2,
    }


def described(spark, root):
    return (statements.files_under(spark, root).withColumn("user_id", F.lit(1).cast("long"))
            .withColumn("account_id", F.lit(2).cast("long")))


def shown(df):
    columns = ["reason", *(f"{r}_raw" for r in statements.ROLES), "paired"]
    found: dict = {}
    for r in df.orderBy("source_file", "line_no").collect():
        found.setdefault(r.source_file.rsplit("/", 1)[1], []).append(
            (r.user_id, r.account_id, *(r[c] for c in columns)))
    return found


@pytest.fixture
def split_bytes(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, n)
    spark.conf.set(name, before)


@pytest.mark.parametrize("size", [600, 128 << 20])
def test_splits_read_what_whole_files_hold(spark, tmp_path, split_bytes, size):
    for name, content in files().items():
        (tmp_path / name).write_bytes(content)
    whole = described(spark, str(tmp_path))
    want = shown(statements.split_files(whole))
    split_bytes(str(size))
    got = shown(splits.read_fields(whole, str(tmp_path)))
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == want[name], name
    if size == 600:
        n = splits.lines_under(spark, str(tmp_path)).select("file_path", "block").distinct().count()
        assert n > 2 * len(want)


def test_a_broken_record_refuses_the_whole_file(spark, tmp_path, split_bytes):
    rows = "".join(f'2024-01-01,"a {i}",-1\n' for i in range(50))
    (tmp_path / "a.csv").write_text("Date,Payee,Amount\n" + rows + '2024-01-01,"' + "x" * 140_000
                                    + '",-1\n' + rows)
    split_bytes("500")
    whole = described(spark, str(tmp_path))
    assert shown(splits.read_fields(whole, str(tmp_path))) == {
        "a.csv": [(1, 2, "unreadable csv", *[None] * 6)]}


def test_no_shuffle_moves_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(files()["plain.csv"])
    whole = described(spark, str(tmp_path))
    plan = splits.read_fields(whole, str(tmp_path))._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    scan = next(part for part in physical.split("Union") if "FileScan text" in part)
    assert "Exchange hashpartitioning" not in scan.split("FileScan text")[0]


def test_load_from_a_folder(spark, tmp_path, split_bytes):
    t0 = dt.datetime(2026, 3, 1)
    home = tmp_path / "user_id=4" / "account=main card"
    home.mkdir(parents=True)
    for name in ("quoted.csv", "plain.csv", "binary.csv", "empty.csv"):
        (home / name).write_bytes(files()[name])
    listed = statements.files_under(spark, str(tmp_path))
    whole = ledger.load_files(store.empty_tables(spark), listed, t0)
    split_bytes("2000")
    parts = ledger.load_files(store.empty_tables(spark), listed.drop("content"), t0, str(tmp_path))
    for name in ("raw_transaction", "subscription", "account"):
        assert parts.tables[name].exceptAll(whole.tables[name]).isEmpty(), name
        assert parts.tables[name].count() == whole.tables[name].count()
    assert sorted(map(str, parts.rejects.collect())) == sorted(map(str, whole.rejects.collect()))
    # Spark lists no empty files.
    assert [r.reason for r in parts.rejects.collect()] == ["binary"]
