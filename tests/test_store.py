"""Snapshots: a load is seen whole or not at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duebook.sources import store

T0 = dt.datetime(2026, 1, 1)


def tables(spark, users, label):
    empty = store.empty_tables(spark)
    rows = [(u * 10, u, label, None, "USD", T0) for u in users]
    merchants = [(u, f"{label} {u}", None) for u in users]
    return {**empty, "account": spark.createDataFrame(rows, store.SCHEMAS["account"]),
            "merchant": spark.createDataFrame(merchants, store.SCHEMAS["merchant"])}


def buckets_of(spark, users):
    return [r[0] for r in spark.createDataFrame([(u,) for u in users], "user_id long").select(
        store.bucket_of()).distinct().collect()]


def seen(spark, root, **how):
    t = store.read_tables(spark, root, **how)
    return ({(r.user_id, r.label) for r in t["account"].collect()},
            {(r.user_id, r.canonical_name) for r in t["merchant"].collect()})


def test_broken_load_leaves_the_old_snapshot(spark, tmp_path):
    root = str(tmp_path / "store")
    assert seen(spark, root) == (set(), set())
    users, some = [1, 2, 3, 4], buckets_of(spark, [2])
    store.write_tables(tables(spark, users, "old"), root, buckets_of(spark, users))
    before = seen(spark, root)
    assert before[0] == {(u, "old") for u in users}

    def broken(value):
        raise ValueError("lost")

    fails = F.udf(broken, "string")
    for name in ("merchant", "price_change"):       # after the first table, and at the last
        new = tables(spark, [2], "new")
        column = new[name].columns[1]
        new[name] = new["merchant"].select(*[
            fails("canonical_name").cast(t).alias(c) if c == column else
            (F.col(c) if c in new["merchant"].columns else F.lit(None).cast(t).alias(c))
            for c, t in new[name].dtypes])
        with pytest.raises(Exception, match="lost"):
            store.write_tables(new, root, some)
        assert seen(spark, root) == before
    store.write_tables(tables(spark, [2], "new"), root, some)
    after = seen(spark, root)
    assert (2, "new") in after[0] and (2, "new 2") in after[1] and (2, "old") not in after[0]
    assert {(u, "old") for u in users if u != 2 and buckets_of(spark, [u]) != some} <= after[0]
    assert seen(spark, root, snapshot=1) == before
    assert seen(spark, root, buckets=some)[0] == {(2, "new")}

    store.drop_versions(spark, root)
    assert seen(spark, root) == after and store.snapshots(spark, root) == [2]
    for name in store.SCHEMAS:
        held = {v for v in store.manifest(spark, root)[name].values()}
        assert set(store.Folder(spark, f"{root}/{name}").names()) == held


def test_emptied_buckets_and_second_writers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    some = buckets_of(spark, [7])
    store.write_tables(tables(spark, [7], "a"), root, some)
    store.write_tables(store.empty_tables(spark), root, some)
    assert seen(spark, root) == (set(), set())
    monkeypatch.setattr(store, "snapshots", lambda *a: [1])
    monkeypatch.setattr(store, "manifest", lambda *a: {n: {} for n in store.SCHEMAS})
    with pytest.raises(RuntimeError, match="another load"):
        store.write_tables(tables(spark, [7], "late"), root, some)
