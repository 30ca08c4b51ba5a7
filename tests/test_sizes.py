"""What only larger tables show: queries against their SQL beyond sf0.1, and how rows meet."""

import os

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kelpline.operators import clusters, text_index
from kelpline.plans.registry import ORACLE, QUERIES
from kelpline.sources.scratch import scratch_root


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df, cur = QUERIES[name](spark, str(folder)), con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    want = sorted((dict(zip(columns, r, strict=True)).items() for r in cur.fetchall()), key=lambda x: repr(sorted(x)))
    got = sorted((r.asDict().items() for r in df.collect()), key=lambda x: repr(sorted(x)))
    assert [sorted(x) for x in got] == [sorted(x) for x in want]
    return len(got)


def test_human_units_beyond_terabytes(spark, tmp_path):
    """The SQL knows no unit above GB; seconds are whole numbers beyond 2 ** 53."""
    keys = spark.range(0, 7_200_000, 60_007).select(F.col("id").alias("p_partkey"))
    keys.write.parquet(str(tmp_path / "part.parquet"))
    assert same_as_sql(spark, tmp_path, "human_units", "part") == 120


def test_hashes_near_by_chance(spark, tmp_path):
    """58 bits of the hashes of unlike texts that differ in 7 or 8: no pair in the SQL. Equal texts are one."""
    texts = [f"text {i}" for i in (7616, 13505, 13750, 20912, 22792, 23740, 22915, 31652)]
    rows = [(64 * k + 5, x) for k, x in enumerate(texts)] + [(64 * k + 1000 + k, texts[k % 3]) for k in range(9)] + [(5000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert same_as_sql(spark, tmp_path, "near_dup_pairs_8", "documents") > 9


def test_long_yaml_lists(spark, tmp_path):
    """20,000 names in each of the three forms, more than a stack holds of a matcher's calls."""
    spark.range(60_000).select(F.col("id").alias("c_custkey"), (F.col("id") % 3).cast("int").alias("c_nationkey"), F.format_string("Name %06d", "id").alias("c_name")).write.parquet(str(tmp_path / "customer.parquet"))
    assert same_as_sql(spark, tmp_path, "yaml_name_list", "customer") == 60_000


def test_schedules_counted(spark, tmp_path):
    """Counts as the pairs would give, of which none are made: 3000 schedules meet 20,000 events."""
    spark.range(3000).select((F.col("id") - F.when(F.col("id") % 100 == 0, 1).otherwise(0)).alias("c_custkey")).filter("c_custkey >= 0").write.parquet(str(tmp_path / "customer.parquet"))
    ts = F.timestamp_seconds(F.col("id") * 7919 % 86_400 + 1_700_000_000)
    spark.range(20_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 50 > 0, ts).alias("ts")).filter("hour(ts) <> 4 or ts is null").write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = QUERIES["customer_schedules"](spark, str(tmp_path))
        df.collect()
        plan = [df._jdf.queryExecution().executedPlan()]
        joined = []
        while plan:
            p = plan.pop()
            plan += [p.children().apply(i) for i in range(p.children().size())]
            if "Join" in p.nodeName():
                joined.append(p.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert joined and max(joined) <= 20_000
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'; create view events as select event_id, ts::timestamp as ts from '{tmp_path}/events.parquet/*.parquet'")
    con.execute("set timezone = 'UTC'")
    want = sorted(con.execute(ORACLE["customer_schedules"]).fetchall())
    assert sorted((r["c_custkey"], r["due"], r["first_event"]) for r in df.collect()) == want and len(want) > 2000


def test_blocks_of_codes(spark):
    """All pairs of 4000 codes, a dense family among them, in blocks of any size; rows of two blocks never meet in a join."""
    rnd = np.random.default_rng(6)
    codes = rnd.integers(-(2**63), 2**63 - 1, 4000)
    codes[500:1100] = codes[500] ^ (1 << rnd.integers(0, 62, 600)) ^ (1 << rnd.integers(0, 62, 600))
    codes = np.unique(codes)
    df = spark.createDataFrame([(f"k{i:05d}", int(c)) for i, c in enumerate(codes)], "name string, h long")
    apart = np.bitwise_count((codes[:, None] ^ codes[None, :]).view(np.uint64))
    want = sorted((f"k{i:05d}", f"k{j:05d}", int(apart[i, j])) for i, j in zip(*np.nonzero(apart <= 18), strict=True) if i < j)
    assert len(want) > 1 << 16  # more than a batch
    for block in (700, clusters.BLOCK):
        pairs = clusters.near_pairs_in_blocks(df, "name", "h", 18, block)
        assert sorted(map(tuple, pairs.collect())) == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of equal codes
    assert plan.count("FlatMapGroupsInArrow") == 1


def test_short_bands_are_no_gain():
    """At 16 of 64 bits a band has 7 bits and each code meets a hundredth of all: blocks are less work, as far as 6 GB go."""
    for codes in (10_000, 102_564, 615_000):
        assert clusters.plan_bands(codes, 64, 16) is None
    assert clusters.plan_bands(10_000_000, 64, 8) is not None


def test_index_keeps_one_copy_of_a_batch(spark, tmp_path):
    """Beside the index a batch leaves its words once, not anew for each step; a block's postings are lists side by side."""
    root = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    rows = [(k, " ".join(f"w{(k * i) % 97}" for i in range(k % 40)), False, 0) for k in range(600)]
    path = f"file://{tmp_path}/i"
    assert text_index.apply_changes(spark.createDataFrame(rows, "key long, text string, deleted boolean, seq int"), path, 0, block=16)
    assert {x.rpartition("-")[0] for x in set(os.listdir(root)) - before} == {"changes", "replaced"}
    want = {(k, w): [i for i, x in enumerate(t.split()) if x == w] for k, t, _, _ in rows for w in set(t.split())}
    assert {(r["key"], r["token"]): r["positions"] for r in text_index.live_postings(spark, path).collect()} == want
