"""Statement lines to transactions: sign convention, accounts, idempotent load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duebook.functions.descriptors import scrub
from duebook.functions.identity import dedup_key
from duebook.operators.merge import merge_keep_first
from duebook.operators.skew import per_key_join

FLIPPED_SHARE = 0.7
EXPANSION = 1024
FILE = ["user_id", "source_file"]


def flipped_files(lines: DataFrame) -> DataFrame:
    """Per file: are charges written as positive numbers? More than 70 % of the
    readable amounts above zero says yes."""
    return (lines.groupBy(*FILE)
            .agg((F.avg((F.col("amount_cents") > 0).cast("int")) > FLIPPED_SHARE)
                 .alias("sign_flipped"), F.count("*").alias("lines")))


def apply_sign(lines: DataFrame, flips: DataFrame, how: str = "left") -> DataFrame:
    """Negative = money out, whatever the file's convention. With ``inner`` lines
    of files without a row in `flips` go."""
    joined = per_key_join(lines, flips, FILE, ["posted_date", "amount_cents", "raw_descriptor"],
                          how, weight="lines")
    return joined.withColumn("amount_cents", F.when(
        F.col("sign_flipped"), -F.col("amount_cents")).otherwise(F.col("amount_cents"))
    ).select(*lines.columns)


def upsert_accounts(accounts: DataFrame, uploads: DataFrame, loaded_at) -> DataFrame:
    """`uploads` (user_id, label, currency): new labels become accounts, known
    ones keep their row and its currency. The id is fixed at creation, so a later
    rename changes nothing that hangs on it."""
    new = uploads.select(
        F.xxhash64("user_id", "label", F.lit(loaded_at)).alias("account_id"), "user_id", "label",
        F.lit(None).cast("string").alias("institution"), "currency",
        F.lit(loaded_at).cast("timestamp").alias("created_at"))
    return merge_keep_first(accounts, new, ["user_id", "label"], ["currency"])


def occurrences(lines: DataFrame) -> DataFrame:
    """Number equal charges of one file 0, 1, 2, ... Equal rows are first counted
    (which combines before the shuffle) and then unfolded again, large counts in
    blocks spread over the cluster, so a charge repeated by the million never
    sits in one task."""
    counted = lines.groupBy(
        *FILE, "account_id", "posted_date", "amount_cents", "raw_descriptor"
    ).agg(F.max("currency").alias("currency"), F.count("*").alias("_n"))

    def upto(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))

    few = (counted.filter(F.col("_n") <= EXPANSION)
           .withColumn("occurrence", upto(F.col("_n"))))
    many = counted.filter(F.col("_n") > EXPANSION)
    big, small = EXPANSION * EXPANSION, EXPANSION
    many = many.withColumn("_big", upto(F.ceil(F.col("_n") / big)))
    many = many.withColumn("_small", upto(F.lit(EXPANSION).cast("bigint")))
    many = (many.withColumn("_at", F.col("_big") * big + F.col("_small") * small)
            .filter(F.col("_at") < F.col("_n"))
            .repartition("raw_descriptor", "_at"))
    many = (many.withColumn("_k", upto(F.lit(EXPANSION).cast("bigint")))
            .withColumn("occurrence", F.col("_at") + F.col("_k"))
            .filter(F.col("occurrence") < F.col("_n")))
    keep = [*lines.columns, "occurrence"]
    return few.select(*keep).unionByName(many.select(*keep))


def new_transactions(lines: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Idempotent load. Two equal charges in one file are two charges; the same
    charge in a second file, or in a table loaded before, is the first one again.
    Of files that share a charge the first by name owns it."""
    keyed = occurrences(lines).withColumn("dedup_hash", dedup_key(
        F.col("user_id"), F.col("account_id"), F.col("posted_date"), F.col("amount_cents"),
        F.col("raw_descriptor"), F.col("occurrence")))
    identity = ["user_id", "account_id", "posted_date", "amount_cents", "raw_descriptor"]
    once = keyed.groupBy("user_id", "dedup_hash").agg(
        *(F.first(c).alias(c) for c in identity if c != "user_id"),
        F.min(F.struct("source_file", "currency")).alias("_file"))
    if existing is not None:
        once = once.join(existing.select("user_id", "dedup_hash"),
                         ["user_id", "dedup_hash"], "left_anti")
    return once.select(
        "user_id", "account_id", "posted_date", "amount_cents",
        F.col("_file.currency").alias("currency"), "raw_descriptor",
        scrub(F.col("raw_descriptor")).alias("scrubbed"),
        F.lit(None).cast("string").alias("merchant"),
        F.col("_file.source_file").alias("source_file"), "dedup_hash")
