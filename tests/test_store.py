from pyspark.sql import functions as F

from kelpline.operators import store


def _expense(spark, rows, participants='["A","B","C"]'):
    e = spark.createDataFrame(rows, "id long, session_id string, paid_by_name string, amount double, split_among string")
    s = spark.createDataFrame([("s", participants)], "session_id string, participants string")
    return {r["name"]: r["balance"] for r in store.balances(e, s).collect()}, store.settlements(store.balances(e, s)).collect()


def test_two_share(spark):
    b, s = _expense(spark, [(1, "s", "A", 1000.0, None)], '["A","B"]')
    assert b == {"A": 500, "B": -500} and [tuple(x) for x in s] == [("s", "B", "A", 500.0)]


def test_three_share(spark):
    assert _expense(spark, [(1, "s", "A", 900.0, None)])[0] == {"A": 600, "B": -300, "C": -300}


def test_split_named(spark):
    assert _expense(spark, [(1, "s", "A", 200.0, '["A","C"]')])[0] == {"A": 100, "C": -100}


def test_split_forms(spark):
    rows = [(1, "s", "A", 300.0, "bad json"), (2, "s", "A", 90.0, "[]"), (3, "s", "A", 30.0, '["B","B","C"]')]
    b, _ = _expense(spark, rows)
    assert b == {"A": 230, "B": -120, "C": -110}


def test_even(spark):
    assert _expense(spark, [(1, "s", "A", 500.0, None), (2, "s", "B", 500.0, None)], '["A","B"]')[1] == []


def test_creditors_are_sorted_anew(spark):
    b = spark.createDataFrame([("s", "c1", 100.0), ("s", "c2", 90.0), ("s", "d1", -60.0), ("s", "d2", -50.0), ("s", "d3", -80.0)], "session_id string, name string, balance double")
    got = sorted(tuple(r)[1:] for r in store.settlements(b).collect())
    assert got == [("d1", "c2", 60.0), ("d2", "c1", 20.0), ("d2", "c2", 30.0), ("d3", "c1", 80.0)]


def test_receipts(spark):
    df = spark.createDataFrame([(1, "s", "f"), (2, "s", "f"), (3, "s", None), (4, "s", None)], "id long, session_id string, photo_file_id string")
    assert sorted(r["id"] for r in store.receipts_once(df, ["session_id"], "photo_file_id", F.col("id")).collect()) == [1, 3, 4]


def test_leaderboard(spark):
    rows = [(1, "Anna", 1, 2.0, "pike"), (2, "anna", 1, 1.0, "carp"), (3, "Bob", 2, 5.0, "pike"), (4, "Zoé", 1, None, "carp"), (5, "ZOÉ", 1, None, "carp")]
    df = spark.createDataFrame(rows, "id long, person string, n int, w double, sp string")
    got = store.leaderboard(df, "person", "n", "w", "sp", F.col("id")).collect()
    assert [(r["person_name"], r["total_weight"], r["species"]) for r in got[:2]] == [("Bob", 5.0, "pike"), ("Anna", 3.0, "carp,pike")]
    assert len(got) == 4 and got[2]["total_weight"] is None  # É isn't folded


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, shown string")
    new = spark.createDataFrame([(1, None, "n1"), (2, "", None), (3, "c", "z")], "id long, name string, shown string")
    got = sorted(tuple(r) for r in store.upsert(old, new, ["id"], ["name"]).collect())
    assert got == [(1, "a", "n1"), (2, "", None), (3, "c", "z")]


def test_insert_ignore_nulls_never_clash(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "e"), (None, "f")], "k long, v string")
    got = sorted((tuple(r) for r in store.insert_ignore(old, new, ["k"], F.col("v")).collect()), key=repr)
    assert got == [(1, "a"), (2, "c"), (None, "e"), (None, "f")]
