"""Writes that touch some folders only, filters of known keys, schedules, settlements of large sessions."""

import os
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kelpline.functions import rules
from kelpline.operators import membership, store
from kelpline.sources import buckets


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_folders_of_other_keys_stay(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, name string, n int"
    rows = {k: (k, f"n{k}", k) for k in range(400)}
    buckets.create(spark.createDataFrame(list(rows.values()), schema), path, ["k"], 16)
    for name, new, want in (
        ("upsert", [(3, None, 33), (1000, "new", 1)], {3: (3, "n3", 33), 1000: (1000, "new", 1)}),
        ("replace", [(3, None, 34), (3000, None, None)], {3: (3, None, 34), 3000: (3000, None, None)}),
    ):
        before = files(path)
        df = spark.createDataFrame(new, schema)
        for _ in range(2):  # a repeated write changes nothing more
            touched = buckets.upsert(spark, path, ["k"], 16, df, ["name"]) if name == "upsert" else buckets.insert_replace(spark, path, ["k"], 16, df)
        rows |= want
        assert {tuple(r) for r in buckets.read(spark, path, schema).collect()} == set(rows.values())
        after = files(path)
        assert len(touched) <= 2 and {f for f in before if after.get(f) != before[f]} == {f for f in before if any(f"/_bucket={b}/" in f for b in touched)}
    buckets.update(spark, path, ["k"], 16, spark.createDataFrame([(5, None), (77_777, 1)], "k long, n int"))
    rows[5] = (5, "n5", None)
    assert {tuple(r) for r in buckets.read(spark, path, schema).collect()} == set(rows.values())
    one = buckets.delete(spark, path, ["k"], 16, spark.createDataFrame([(k,) for k in rows], "k long"))
    assert len(one) == 16 and buckets.read(spark, path, schema).count() == 0
    assert buckets.upsert(spark, path, ["k"], 16, spark.createDataFrame([], schema), []) == []
    buckets.insert_replace(spark, path, ["k"], 16, spark.createDataFrame([(9, "back", 9)], schema))
    assert [tuple(r) for r in buckets.read(spark, path, schema).collect()] == [(9, "back", 9)]


@pytest.mark.parametrize("most", [membership.MOST_BYTES, 0])
def test_filter_of_known_keys(spark, tmp_path, most):
    """Exact with any filter; what is looked up is little more than what is known."""
    known = spark.range(0, 6000).select(F.concat(F.lit("k"), F.col("id") * 2).alias("key"))
    paths = [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")]
    for path, part in zip(paths, (known.filter("hash(key) % 2 = 0"), known.filter("hash(key) % 2 <> 0"), known.limit(0)), strict=True):
        membership.write_filter(part, "key", path)
    rows = spark.range(0, 12_000).select("id", F.concat(F.lit("k"), F.col("id")).alias("key")).unionByName(spark.createDataFrame([(-1, None)], "id long, key string"))
    got = sorted(r["id"] for r in membership.unseen(rows, "key", known, paths, most).select("id").collect())
    assert got == [-1, *range(1, 12_000, 2)]
    new, maybe = membership.split(rows, "key", known, paths, most)
    if most:
        assert 6000 <= maybe.count() <= 6000 * 1.05 and new.count() + maybe.count() == 12_001
    else:
        assert new.count() == 0 and maybe.count() == 12_001


def test_schedules_by_bins(spark):
    events = spark.range(0, 1440).select("id", (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("ts"))
    times = spark.createDataFrame([(i, f"{m // 60:02d}:{m % 60:02d}") for i, m in enumerate(range(0, 1440, 7))] + [(9000, "late"), (9001, None)], "user int, at string")
    pairs = store.due_for(events, times, rules.minute_of_day(F.col("ts")), rules.schedule_minutes(F.col("at")))
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["id"], r["user"]) for r in pairs.collect())
    assert got == sorted((e, i) for e in range(1440) for i, m in enumerate(range(0, 1440, 7)) if abs(e - m) <= 5)


def plain_settlement(people, least):
    """Debtor by debtor over creditors that are sorted anew for each."""
    due = {name: x for name, x in people if x > least}
    out = []
    for debt, debtor in sorted((x, name) for name, x in people if -x > least):
        rest = -debt
        for name in sorted(due, key=lambda n: (-due[n], n)):
            if due[name] > least and rest > least:
                amount = min(rest, due[name])
                out.append((debtor, name, amount))
                due[name] -= amount
                rest -= amount
    return out


def test_settlements_by_heap():
    rnd = random.Random(8)
    for n in (0, 1, 2, 9, 60):
        for _ in range(20):
            people = [(f"p{k:02d}", Decimal(rnd.choice([rnd.randrange(-900, 900), rnd.randrange(-3, 4)])) / 100) for k in range(n)]
            assert store.settled(people, Decimal("0.01")) == plain_settlement(people, Decimal("0.01"))


def test_settlement_of_a_large_session(spark):
    rnd = random.Random(9)
    values = [rnd.randrange(-50_000, 50_000) for _ in range(19_999)]
    rows = [("s", f"p{k}", v / 100) for k, v in enumerate([*values, -sum(values)])]
    df = spark.createDataFrame(rows, "session_id string, name string, b double").select("session_id", "name", F.col("b").cast("decimal(20,6)").alias("balance"))
    began = time.time()
    moves = store.settlements(df).collect()
    assert time.time() - began < 30
    left = {name: Decimal(str(b)) for _, name, b in rows}
    for m in moves:
        left[m["debtor"]] += Decimal(str(m["amount"]))
        left[m["creditor"]] -= Decimal(str(m["amount"]))
    assert all(abs(x) <= Decimal("0.02") for x in left.values())
