"""Statement data derived by Spark from the given tables.

``event_lines``  irregular charges: one line per event
``part_lines``   regular charges: each part is one subscription whose cadence,
                 price step, missed charge and currency follow from its key
``order_lines``  purchases with a wide date range: one line per order
``event_files``  the event lines written out as CSV statement bytes
``write_statements``  the events as statement files in folders, some fields quoted
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duebook.functions.descriptors import scrub
from duebook.operators.skew import by_python_key

PARTS_PER_TENANT = 40
EVENTS_PER_FILE = 65_536


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The needed columns of a table. One lone small file would keep all but one
    core idle, so fewer splits than cores are dealt out again; big tables have
    enough splits and are left as they are."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns or ("*",))
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        "user_id", (F.col("user_id") % 3).alias("account_id"),
        F.to_date("ts").alias("posted_date"),
        (-F.rint(F.col("value") * 100)).cast("bigint").alias("amount_cents"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("SQ *"), F.upper("event_type"), F.lit(" #"),
                 (F.col("event_id") % 97).cast("string")).alias("raw_descriptor"),
        F.concat(F.lit("events-"), (F.col("event_id") % 4).cast("string")).alias("source_file"))


def _by_key(key: Column, *values) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)),
                        (key % len(values) + 1).cast("int"))


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = F.col("p_partkey"), F.col("i")
    length = 2 + p % 11
    back = length - i
    end = F.date_sub(F.lit("2024-12-28").cast("date"), (p * 37 % 150).cast("int"))
    months = F.when(p % 7 == 3, 1).when(p % 7 == 4, 3).when(p % 7 == 5, 6).when(p % 7 == 6, 12)
    days = (F.when(p % 7 == 0, back * 7).when(p % 7 == 1, back * 14)
            .otherwise(F.floor(back * 15.2).cast("bigint")))
    posted = (F.when(months.isNotNull(), F.add_months(end, (-months * back).cast("int")))
              .otherwise(F.date_sub(end, days.cast("int"))))
    base = F.rint(F.col("p_retailprice") * 100).cast("bigint")
    amount = (F.when(p % 9 == 4, base + (i * 7919) % 40000)
              .when((p % 4 == 0) & (i * 2 > length), base + F.floor(base / 10))
              .otherwise(base))
    return (read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_retailprice")
            .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), length)))
            .filter(~((p % 5 == 0) & (i == 2)))
            .select(
                (F.floor(p / PARTS_PER_TENANT) + 1).alias("user_id"),
                (p % 2).alias("account_id"),
                posted.alias("posted_date"), (-amount).alias("amount_cents"),
                _by_key(p, "USD", "USD", "USD", "EUR", "JPY", "KWD").alias("currency"),
                F.concat(_by_key(p, "", "SQ *", "PAYPAL *", "POS DEBIT ", "SP * "),
                         F.upper("p_name"), F.lit(" "), F.col("p_type"),
                         _by_key(i, "", " 866-579-7172", " #A17", " CA", " 12/31 USA"))
                .alias("raw_descriptor"),
                F.concat(F.lit("parts-"), (p % 3).cast("string")).alias("source_file")))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                "o_totalprice", "o_orderpriority").select(
        F.col("o_custkey").alias("user_id"), F.lit(1).cast("bigint").alias("account_id"),
        F.to_date("o_orderdate").alias("posted_date"),
        (-F.rint(F.col("o_totalprice") * 100)).cast("bigint").alias("amount_cents"),
        F.lit("USD").alias("currency"), F.col("o_orderpriority").alias("raw_descriptor"),
        F.concat(F.lit("orders-"), (F.col("o_orderkey") % 8).cast("string"))
        .alias("source_file"))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement files as (user_id, path, content). A file takes lines
    of at most 65,536 consecutive events, whoever they belong to, so no file grows with the data. Layouts vary
    by file: separator, column names, date order, sign and encoding."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value"
             ).withColumn("block", F.floor(F.col("event_id") / EVENTS_PER_FILE))
    kind = (F.col("block") + F.col("user_id")) % 4
    day, cents = F.to_date("ts"), F.rint(F.col("value") * 100).cast("bigint")
    text = F.concat(F.lit("SQ *"), F.upper("event_type"), F.lit(" #"),
                    (F.col("event_id") % 97).cast("string"))
    plain = F.format_string("%d.%02d", F.floor(cents / 100), cents % 100)
    comma = F.format_string("%d,%02d", F.floor(cents / 100), cents % 100)
    line = (F.when(kind == 0, F.concat(F.date_format(day, "MM/dd/yyyy"), F.lit(","), text,
                                       F.lit(",-"), plain))
            .when(kind == 1, F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(";"), text,
                                      F.lit(";-"), comma))
            .when(kind == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("\t"), text,
                                      F.lit("\t"), plain, F.lit("\t")))
            .otherwise(F.concat(F.date_format(day, "yyyy/MM/dd"), F.lit("|"), text,
                                F.lit("|"), plain)))
    head = _by_key(F.col("kind"), "Date,Description,Amount", "Buchung;Verwendungszweck;Betrag",
                   "Posted\tDetails\tDebit\tCredit", "Valuta|Libellé|Montant")
    body = F.concat_ws("\n", F.transform(F.array_sort("lines"), lambda s: s["line"]))
    lines = e.select("user_id", "block", kind.alias("kind"), "event_id", line.alias("line"))
    return (by_python_key(lines, ["user_id", "block"]).groupBy("user_id", "block", "kind")
            .agg(F.collect_list(F.struct("event_id", "line")).alias("lines"))
            .select("user_id", F.concat_ws("/", F.lit("drop"), "user_id", F.concat(
                F.col("block").cast("string"), F.lit(".csv"))).alias("path"),
                F.when(F.col("kind") == 3, F.encode(F.concat_ws("\n", head, body), "ISO-8859-1"))
                .otherwise(F.encode(F.concat_ws("\n", head, body), "UTF-8"))
                .alias("content")))


def write_statements(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Files below `root`, one for each of four tenants and 65,536 consecutive events, in a
    layout and encoding of the tenant's own. A fifth of the descriptors has a line break
    and separators in quotes."""
    e = read(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    kind = F.col("event_id") % 4
    day, cents = F.to_date("ts"), F.rint(F.col("value") * 100).cast("bigint")
    code = (F.col("event_id") % 97).cast("string")
    name = F.concat(F.lit("SQ *"), F.upper("event_type"), F.lit(" #"), code)
    text = F.when(F.col("event_id") % 5 == 0, F.concat(
        F.lit('"'), name, F.lit("\nSAID "), code, F.lit(", 1; "), "event_id", F.lit('"'))
        ).otherwise(name)
    units, rest = F.floor(cents / 100), F.lpad((cents % 100).cast("string"), 2, "0")
    line = _by_key(
        kind, *(F.concat_ws(separator, F.date_format(day, form), text, F.concat(
            F.lit(sign), units, F.lit(point), rest, F.lit(end)))
            for separator, form, sign, point, end in (
                (",", "MM/dd/yyyy", "-", ".", ""), (";", "dd.MM.yyyy", "-", ",", ""),
                ("\t", "yyyy-MM-dd", "", ".", "\t"), ("|", "yyyy/MM/dd", "", ".", ""))))
    head = _by_key(kind, "Date,Description,Amount", "Buchung;Verwendungszweck;Betrag",
                   "Posted\tDetails\tDebit\tCredit", "Valuta|Libellé|Montant")
    rows = e.select((kind + 1).alias("user_id"),
                    F.floor(F.col("event_id") / EVENTS_PER_FILE).alias("account"),
                    "event_id", line.alias("value"), head.alias("head"))
    heads = rows.groupBy("user_id", "account").agg(F.first("head").alias("value")).select(
        "user_id", "account", F.lit(-1).cast("long").alias("event_id"), "value")
    lines = by_python_key(rows.drop("head").unionByName(heads), ["user_id", "account"])
    encoded = F.when(F.col("user_id") == 4, F.encode("value", "ISO-8859-1")).otherwise(
        F.encode("value", "UTF-8")).cast("string")
    (lines.sortWithinPartitions("user_id", "account", "event_id")
     .select("user_id", "account", encoded.alias("value"))
     .write.partitionBy("user_id", "account").text(root))


def exact_transactions(lines: DataFrame) -> DataFrame:
    """Lines with the exact tier only: each scrubbed name is its own merchant."""
    name = F.coalesce(scrub(F.col("raw_descriptor")), F.lit(""))
    return lines.withColumn("scrubbed", name).withColumn("merchant", F.col("scrubbed"))
