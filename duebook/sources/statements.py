"""Statement files to typed lines.

Bytes and CSV dialects are the one place that needs Python: a file that comes as a column
is decoded and split inside ``mapInPandas``; files in folders are read in byte ranges
(``splits``). Column
values leave it as text; dates, amounts and signs are parsed by native columns.
Nothing here fails a job: what cannot be read becomes a row with a ``reason``.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.functions.dates import parse_date
from duebook.functions.descriptors import strip
from duebook.functions.money import parse_amount
from duebook.operators.load import FILE, FLIPPED_SHARE, apply_sign

# ---- fixed values: the header words of each column's role, and the like -----
EXTENSIONS = (".csv", ".txt", ".tsv")
SNIFF_CHARS = 8192
LABEL_CHARS = 64
DELIMITERS = ",;\t|"
DATE_WORDS = ("post date", "posted", "date", "datum", "fecha", "data", "dato", "tarih",
              "päivä", "buchung", "valuta")
DESCRIPTION_WORDS = ("description", "beschreibung", "verwendungszweck", "buchungstext",
                     "merchant", "payee", "narrative", "details", "concepto",
                     "descrizione", "omschrijving", "libellé", "libelle", "tekst",
                     "opis", "name", "particulars")
AMOUNT_WORDS = ("amount", "betrag", "importe", "importo", "montant", "bedrag", "kwota",
                "belopp", "beløb", "summa", "value")
NOT_AMOUNT_WORDS = ("running", "balance", "saldo", "solde")
DEBIT_WORDS = ("debit", "withdrawal", "soll", "débito", "debito", "obciążenie", "uttag")
CREDIT_WORDS = ("credit", "deposit", "haben", "crédito", "credito", "uznanie",
                "insättning")
ROLE_WORDS = {"date": (DATE_WORDS,), "description": (DESCRIPTION_WORDS,),
              "amount": (AMOUNT_WORDS, NOT_AMOUNT_WORDS), "debit": (DEBIT_WORDS,),
              "credit": (CREDIT_WORDS,)}
# ---------------------------------------------------------------------------

OUTPUT_ROWS = 10_000
META = ["user_id", "account_id", "currency", "dayfirst", "flip_sign", "source_file"]
META_TYPES = ("user_id bigint, account_id bigint, currency string, dayfirst boolean, "
              "flip_sign boolean, source_file string")
ROLES = ["date", "description", "amount", "debit", "credit"]
FIELD = META_TYPES + ", line_no bigint, reason string, " + ", ".join(
    f"{r}_raw string" for r in ROLES) + ", paired boolean"


def column_for(headers: list[str], words, barred=()) -> str | None:
    """The header that plays a role: the earliest word decides, then position."""
    ranked = [(w, at, h) for at, h in enumerate(headers)
              for w, word in enumerate(words)
              if word in h.lower() and not any(b in h.lower() for b in barred)]
    return min(ranked)[2] if ranked else None


def decode(raw: bytes) -> tuple[str | None, str | None]:
    """-> (text, reason)"""
    if not raw:
        return None, "empty"
    for codec in ("utf-8-sig", "cp1252"):
        try:
            text = raw.decode(codec)
            break
        except UnicodeDecodeError:
            continue
    else:
        return None, "not text"
    return (None, "binary") if "\x00" in text else (text, None)


def separator_of(text: str) -> tuple[str, bool] | None:
    """The separator of text without quote characters, and whether a space follows it: what
    ``csv.Sniffer`` finds. That counts all of ASCII on every line; here only what may be a
    separator is counted."""
    lines = [x for x in text.split("\n") if x]
    step = min(10, len(lines))
    counts, modes, found = {d: {} for d in DELIMITERS}, {}, {}
    for start in range(0, len(lines), step or 1):
        for line in lines[start:start + step]:
            for d, times in counts.items():
                n = line.count(d)
                times[n] = times.get(n, 0) + 1
        total = min(start + step, len(lines))
        for d, times in counts.items():
            n, most = max(times.items(), key=lambda x: x[1])
            modes[d] = n, 2 * most - total
        consistency = 1.0
        while not found and consistency >= 0.9:
            found = {d: m for d, m in modes.items()
                     if m[0] > 0 and m[1] > 0 and m[1] / total >= consistency}
            consistency -= 0.01
        if len(found) == 1:
            break
    if not found:
        return None
    best = next((d for d in (",", "\t", ";") if d in found),
                max(found, key=lambda d: (found[d], d)))
    return best, lines[0].count(best) == lines[0].count(best + " ")


def dialect_of(text: str):
    """Separator and quoting, from the header and the whole lines that follow it."""
    end = text.rfind("\n", 0, SNIFF_CHARS) + 1 or text.find("\n") + 1 or len(text)
    text = text[:end]
    if '"' in text or "'" in text:
        try:
            return csv.Sniffer().sniff(text, delimiters=DELIMITERS)
        except csv.Error:
            return csv.excel
    found = separator_of(text)
    if found is None:
        return csv.excel

    class Plain(csv.excel):
        delimiter, skipinitialspace = found
        doublequote = False
    return Plain


#: What a file must have: columns of at least one of the roles, or the reason it is refused.
NEEDED = ((("date",), "no date or description column"),
          (("description",), "no date or description column"),
          (("amount", "debit"), "no amount or debit column"))


def split_file(raw: bytes):
    """-> (reason, role columns, row iterator) of one statement file."""
    text, reason = decode(raw)
    if reason:
        return reason, None, ()
    reader = csv.DictReader(io.StringIO(text), dialect=dialect_of(text))
    try:
        headers = [h for h in (reader.fieldnames or []) if h]
    except csv.Error:
        return "unreadable csv", None, ()
    if not headers:
        return "no header", None, ()
    roles = {role: column_for(headers, *words) for role, words in ROLE_WORDS.items()}
    for any_of, reason in NEEDED:
        if not any(roles[role] for role in any_of):
            return reason, None, ()
    return None, roles, reader


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [*META, "line_no", "reason", *(f"{r}_raw" for r in ROLES), "paired"]
    out = []
    for pdf in batches:
        for rec in pdf.itertuples(index=False):
            meta = [getattr(rec, m) for m in META]
            reason, roles, rows = split_file(bytes(rec.content or b""))
            mine = []
            try:
                for n, row in enumerate(rows):
                    mine.append([*meta, n, None,
                                 *(row.get(roles[r]) if roles[r] else None for r in ROLES),
                                 roles["amount"] is None])
                reason = reason or (None if mine else "no usable rows")
            except csv.Error:
                reason = "unreadable csv"
            out += [[*meta, None, reason, *[None] * len(ROLES), None]] if reason else mine
            if len(out) >= OUTPUT_ROWS:
                yield pd.DataFrame(out, columns=columns, dtype=object)
                out = []
    if out:
        yield pd.DataFrame(out, columns=columns, dtype=object)


def files_under(spark: SparkSession, root: str) -> DataFrame:
    """Files below `root`. Their settings are ``name=value`` folders on the path:
    user_id (needed), account, currency, dayfirst, flip_sign. Nothing is read here;
    ``splits.read_fields`` reads the files in byte ranges."""
    return describe_files(spark.read.format("binaryFile")
                          .option("recursiveFileLookup", "true").load(root)
                          .select("*", "_metadata.file_path"))


def describe_files(files: DataFrame) -> DataFrame:
    def setting(name):
        found = F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
        return F.when(found != "", F.try_url_decode(found))
    label = F.trim(setting("account"))
    return files.select(
        setting("user_id").try_cast("bigint").alias("user_id"),
        F.when(F.coalesce(label, F.lit("")) == "", F.lit("card")).otherwise(label)
        .alias("label"),
        F.upper(F.coalesce(setting("currency"), F.lit("USD"))).alias("currency"),
        F.coalesce(setting("dayfirst").try_cast("boolean"), F.lit(False)).alias("dayfirst"),
        setting("flip_sign").try_cast("boolean").alias("flip_sign"),
        F.col("path").alias("source_file"),
        *(c for c in ("file_path", "length", "content") if c in files.columns))


def _known_bad():
    name = F.lower("source_file")
    return (F.when(~F.greatest(*(name.endswith(e) for e in EXTENSIONS)),
                   F.lit("not a .csv, .txt or .tsv file"))
            .when(F.col("user_id").isNull(), F.lit("no user"))
            .when(F.length("label") > LABEL_CHARS,
                  F.lit(f"account label above {LABEL_CHARS} characters"))
            .when(~F.col("currency").rlike("^[A-Z]{3}$"), F.lit("currency is not three letters")))


def readable_files(files: DataFrame) -> DataFrame:
    """Files worth opening. Name and settings are checked before content is read."""
    return files.filter(_known_bad().isNull())


def unopened_rejects(files: DataFrame) -> DataFrame:
    return (files.select("user_id", "source_file", _known_bad().alias("reason"))
            .filter("reason is not null"))


def split_files(files: DataFrame) -> DataFrame:
    """Text fields of every line, plus one row with a reason per unreadable file, from
    files whose content is a column. Such files are small; ``splits.read_fields`` gives the
    same rows for files of any size in a folder."""
    return files.select(*META, "content").mapInPandas(_read_batches, FIELD)


def typed_lines(fields: DataFrame) -> DataFrame:
    """Parse the text fields. Lines without a date, an amount or a descriptor stay
    as rows with ``usable = false`` so that they can be counted."""
    currency = F.col("currency")
    debit, credit = (parse_amount(F.col(f"{c}_raw"), currency) for c in ("debit", "credit"))
    parsed = (fields.filter("reason is null")
              .withColumn("posted_date", parse_date(F.col("date_raw"), F.col("dayfirst")))
              .withColumn("raw_descriptor", strip(F.coalesce("description_raw", F.lit(""))))
              .withColumn("_amount", F.when(~F.col("paired"), parse_amount(
                  F.col("amount_raw"), currency)))
              .withColumn("_debit", F.when(F.col("paired"), debit))
              .withColumn("_credit", F.when(F.col("paired"), credit)))
    amount = (F.when(~F.col("paired"), F.col("_amount"))
              .when(F.col("_debit") != 0, -F.abs("_debit"))
              .when(F.col("_credit") != 0, F.abs("_credit")))
    return (parsed.withColumn("amount_cents", amount)
            .withColumn("usable", F.col("posted_date").isNotNull()
                        & F.col("amount_cents").isNotNull() & (F.col("raw_descriptor") != ""))
            .drop("_amount", "_debit", "_credit"))


def file_facts(typed: DataFrame) -> DataFrame:
    """Per file: usable and skipped lines, sign convention, and why it is refused."""
    usable = F.col("usable")
    positive = F.when(usable, (F.col("amount_cents") > 0).cast("int"))
    return (typed.groupBy(*FILE).agg(
        F.count_if(usable).alias("rows_read"), F.count_if(~usable).alias("rows_skipped"),
        F.bool_and("paired").alias("paired"),
        F.coalesce(F.max("flip_sign"), F.avg(positive) > FLIPPED_SHARE, F.lit(False))
        .alias("sign_flipped"))
        .withColumn("reason", F.when(F.col("rows_read") == 0, "no usable rows")))


def signed_lines(typed: DataFrame, facts: DataFrame) -> DataFrame:
    """Usable lines of accepted files, negative = money out. A debit/credit pair
    already says which way money went and is never flipped."""
    good = facts.filter("reason is null").select(
        *FILE, (F.col("sign_flipped") & ~F.col("paired")).alias("sign_flipped"),
        F.col("rows_read").alias("lines"))
    lines = typed.filter("usable").select(
        "user_id", "account_id", "posted_date", "amount_cents", "currency",
        "raw_descriptor", "source_file")
    return apply_sign(lines, good, "inner")


def rejects(files: DataFrame, fields: DataFrame, facts: DataFrame) -> DataFrame:
    """Every refused file with its reason."""
    columns = [*FILE, "reason"]
    return (unopened_rejects(files)
            .unionByName(fields.filter("reason is not null").select(*columns))
            .unionByName(facts.filter("reason is not null").select(*columns)))
