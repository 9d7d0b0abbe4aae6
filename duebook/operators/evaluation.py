"""Detector quality against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: name pattern -> cadence of the published sample ----------
SAMPLE_TRUTH = (
    (r"^NETFLIX", "monthly"),
    (r"^APPLE BILL", "monthly"),
    (r"^HBOMAX", "monthly"),
    (r"AMAZON PRIME", "monthly"),
    (r"^GOOGLE HULU", "monthly"),
    (r"^SUPER$", "monthly"),
    (r"^ZXC SITE", "monthly"),
    (r"^CLAUDE AI", "monthly"),
    (r"AWS", "monthly"),
    (r"^NAMECHEAP", "annual"),
)
# ---------------------------------------------------------------------------

MERCHANT = ["user_id", "merchant"]


def expected_by_pattern(merchants: DataFrame, truth=SAMPLE_TRUTH) -> DataFrame:
    """Label merchants: the first pattern found in the name gives the cadence. The
    list is code, so it becomes one expression and no join."""
    name = F.col("merchant")
    return merchants.withColumn("expected", F.coalesce(
        *(F.when(name.rlike(p), cadence) for p, cadence in truth)))


def judgements(labelled: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row per merchant: expected and detected cadence, and the outcome."""
    detected = subscriptions.groupBy(*MERCHANT).agg(
        F.min_by("cadence", "account_id").alias("detected"))
    want, got = F.col("expected"), F.col("detected")
    outcome = (F.when(want.isNotNull() & got.isNotNull(), "TP")
               .when(want.isNotNull(), "FN").when(got.isNotNull(), "FP").otherwise("TN"))
    return (labelled.select(*MERCHANT, "expected").join(detected, MERCHANT, "left")
            .withColumn("outcome", outcome)
            .withColumn("wrong_cadence", (outcome == "TP") & (want != got)))


def errors(judged: DataFrame) -> DataFrame:
    """False positives, misses and wrong cadences, by name."""
    return judged.filter("outcome in ('FP', 'FN') or wrong_cadence")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def scores(judged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision, recall, F1 and cadence accuracy."""
    def n(kind):
        return F.count_if(F.col("outcome") == kind).alias(kind.lower())
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.col("precision"), F.col("recall")
    return (judged.groupBy(*(by or [])).agg(
        n("TP"), n("TN"), n("FP"), n("FN"),
        F.count_if((F.col("outcome") == "TP") & ~F.col("wrong_cadence")).alias("cadence_right"))
        .withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * p * r, p + r))
        .withColumn("cadence_accuracy", _ratio(F.col("cadence_right"), tp)))
