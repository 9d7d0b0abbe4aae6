"""Load, merges, skew helpers, attempts, evaluation."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duebook.operators import attempts, evaluation, load, merge, skew
from duebook.sources import schemas
from duebook.streaming import attempt_limits

DAY = dt.date(2026, 1, 1)


def lines(spark, rows):
    return spark.createDataFrame([(1, 1, DAY, cents, "USD", text, source)
                                  for cents, text, source in rows], schemas.LINE)


def test_occurrences_and_overlap(spark):
    rows = [(-100, "COFFEE", "a")] * 3 + [(-100, "COFFEE", "b")] * 2 + [(-5, "TEA", "b")]
    new = load.new_transactions(lines(spark, rows))
    assert sorted((r.raw_descriptor, r.source_file) for r in new.collect()) == [
        ("COFFEE", "a")] * 3 + [("TEA", "b")]
    import hashlib
    want = {hashlib.sha256(f"1|1|2026-01-01|-100|COFFEE|{n}".encode()).hexdigest()
            for n in range(3)}
    assert {r.dedup_hash for r in new.filter("raw_descriptor = 'COFFEE'").collect()} == want
    more = load.new_transactions(lines(spark, rows + [(-100, "COFFEE", "b")] * 2), new)
    assert more.count() == 1


def test_one_charge_repeated_thousands_of_times(spark):
    n = 2 * load.EXPANSION + 77
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("user_id"), F.lit(1).cast("long").alias("account_id"),
        F.lit(DAY).alias("posted_date"), F.lit(-100).cast("long").alias("amount_cents"),
        F.lit("USD").alias("currency"), F.lit("COFFEE").alias("raw_descriptor"),
        F.lit("a").alias("source_file"))
    out = load.occurrences(df)
    assert out.agg(F.count("*"), F.countDistinct("occurrence"), F.max("occurrence")
                   ).first()[:] == (n, n, n - 1)
    assert load.new_transactions(df, load.new_transactions(df)).count() == 0


def test_flips(spark):
    rows = ([(100, "A", "pos")] * 8 + [(-100, "B", "pos")] * 2 + [(100, "A", "edge")] * 7
            + [(-100, "B", "edge")] * 3)
    df = lines(spark, rows)
    flips = load.flipped_files(df)
    assert {r.source_file: r.sign_flipped for r in flips.collect()} == {"pos": True, "edge": False}
    signed = load.apply_sign(df, flips)
    assert signed.columns == df.columns
    assert {(r.source_file, r.raw_descriptor): r.amount_cents for r in signed.collect()} == {
        ("pos", "A"): -100, ("pos", "B"): 100, ("edge", "A"): 100, ("edge", "B"): -100}


def test_accounts_keep_currency_and_id(spark):
    none = spark.createDataFrame([], schemas.ACCOUNT)
    up = spark.createDataFrame([(1, "card", "USD")], "user_id long, label string, currency string")
    first = load.upsert_accounts(none, up, dt.datetime(2026, 1, 1))
    second = load.upsert_accounts(first, up.withColumn("currency", F.lit("EUR")),
                                  dt.datetime(2026, 1, 2))
    assert first.collect() == second.collect()


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, v int")
    new = spark.createDataFrame([(2, "x", None), (3, "y", 9)], "k int, s string, v int")
    assert sorted(merge.merge_keep_first(old, new, ["k"]).collect()) == [
        (1, "a", 1), (2, "b", 2), (3, "y", 9)]
    assert sorted(tuple(r) for r in merge.merge_update(old, new, ["k"], ["v"]).collect()) == [
        (1, "a", 1), (2, "b", None), (3, "y", 9)]


@pytest.mark.parametrize("weight", [None, "n"])
@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_per_key_join(spark, monkeypatch, how, weight):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    rows = [(1, i) for i in range(60)] + [(2, i) for i in range(3)] + [(None, 1), (4, 1)]
    big = spark.createDataFrame(rows, "k int, v int")
    small = spark.createDataFrame([(1, "hot", 60), (2, "cold", 3), (3, "none", 0)],
                                  "k int, s string, n int")
    got = skew.per_key_join(big, small, ["k"], ["v"], how, weight)
    want = big.join(small, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("longest", [0, 100])
def test_join_list(spark, monkeypatch, longest):
    monkeypatch.setattr(skew, "LIST_ROWS", longest)
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    df = spark.range(90).select((F.col("id") % 3).alias("user_id"), "id")
    listed = spark.createDataFrame([(1,), (1,), (9,)], "user_id long")
    assert skew.join_list(df, listed, ["user_id"], "left_semi").count() == 30
    assert skew.join_list(df, listed, ["user_id"], "left_anti").count() == 60


def test_top_rows_beyond_the_group_limit(spark, monkeypatch):
    monkeypatch.setattr(skew, "GROUP_LIMIT", 5)
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 500).alias("v"))
    got = skew.top_rows(df, ["k"], [F.desc("v")], 20)
    want = skew.top_rows(df, ["k"], [F.desc("v")], 4)
    assert got.groupBy("k").count().collect() and got.count() == 60
    assert set(map(tuple, want.collect())) <= set(map(tuple, got.collect()))


def log(spark, seed, n=300, keys=3):
    rng = random.Random(seed)
    t0 = dt.datetime(2026, 1, 1)
    rows = []
    for i in range(n):
        t0 += dt.timedelta(seconds=rng.choice([0, 1, 30, 200, 900, 1000]))
        rows.append((rng.choice(["login", "reset"]), f"k{rng.randrange(keys)}", t0,
                     rng.random() < 0.05, i))
    return rows, spark.createDataFrame(
        rows, "kind string, key string, at timestamp, cleared boolean, id int")


def slow_replay(rows):
    kept, out = {}, {}
    for kind, key, at, cleared, i in sorted(rows, key=lambda r: (r[2], r[3], r[4])):
        limit, seconds = attempts.LIMITS[kind]
        recent = [t for t in kept.get((kind, key), []) if t > at - dt.timedelta(seconds=seconds)]
        out[i] = len(recent) < limit
        if out[i]:
            recent = [] if cleared else [*recent, at]
        kept[kind, key] = recent
    return out


@pytest.mark.parametrize("split", [None, 20])
def test_replay(spark, split):
    rows, df = log(spark, 3)
    got = {r.id: r.accepted for r in attempts.replay(df, split_rows=split).collect()}
    assert got == slow_replay(rows) and False in got.values()


def test_trailing_rate(spark):
    rows, df = log(spark, 4)
    for r in attempts.trailing_rate(df).collect():
        limit, seconds = attempts.LIMITS[r.kind]
        recent = sum(k == r.kind and key == r.key and
                     r.at - dt.timedelta(seconds=seconds) < at <= r.at
                     for k, key, at, _, _ in rows) - 1
        assert (r.recent, r.flagged) == (recent, recent >= limit)


def test_attempt_stream(spark, tmp_path):
    rows, df = log(spark, 5, 80, 2)
    df = df.drop("cleared", "id")
    plain_rows = [(k, key, at, False, i) for k, key, at, _, i in rows]
    df.coalesce(1).sortWithinPartitions("at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = (attempt_limits.limited(stream).writeStream.format("memory").queryName("limited_attempts")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.kind, r.key, r.at, r.accepted)
                 for r in spark.table("limited_attempts").collect())
    want = slow_replay(plain_rows)
    assert got == sorted((k, key, at, want[i]) for k, key, at, _, i in plain_rows)


def test_scores(spark):
    merchants = spark.createDataFrame(
        [(1, m) for m in ("NETFLIX", "AWS EMEA", "NAMECHEAP", "BAKERY", "GYM")],
        "user_id long, merchant string")
    subs = spark.createDataFrame(
        [(1, "NETFLIX", 1, "monthly"), (1, "NAMECHEAP", 1, "monthly"), (1, "GYM", 1, "weekly")],
        "user_id long, merchant string, account_id long, cadence string")
    judged = evaluation.judgements(evaluation.expected_by_pattern(merchants), subs)
    s = evaluation.scores(judged).first()
    assert (s.tp, s.tn, s.fp, s.fn, s.cadence_right) == (2, 1, 1, 1, 1)
    assert (round(s.precision, 3), round(s.recall, 3), s.cadence_accuracy) == (0.667, 0.667, 0.5)
    assert {r.merchant for r in evaluation.errors(judged).collect()} == {
        "GYM", "AWS EMEA", "NAMECHEAP"}
    none = evaluation.scores(judged.filter("outcome = 'TN'")).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
