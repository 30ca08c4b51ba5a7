"""Every query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from kelpline.plans.registry import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cur = duck.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in cur.fetchall()), key=repr)
    assert got == want


def test_near_duplicates_as_surveyed(spark):
    larger = DIR.replace("sf0.001", "sf0.01")
    if not os.path.isdir(larger):
        pytest.skip("no test tables")
    assert QUERIES["near_dup_pairs_64"](spark, larger).count() == 40
    rows = QUERIES["near_dup_clusters_64"](spark, larger).collect()
    assert len(rows) == 71 and len({r["component"] for r in rows}) == 32


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_context_against_conversations():
    assert "conversations" in ORACLE["rag_context_conversations"]
