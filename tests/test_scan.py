"""Scans over ranges against plain loops, also if one key holds half of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from kelpline.operators import intake, scan

ROWS = 6000


@pytest.fixture(scope="module")
def rows():
    """(key, at, word): key 0 has half of the rows, null is a key, and long stretches are alike."""
    rnd, out, word = random.Random(3), [], None
    for at in range(ROWS):
        if rnd.random() < 0.05:
            word = rnd.choice([None, "", "a", "b", "error"])
        out.append((0 if at % 2 else rnd.choice([None, 1, 2, 3, *range(10, 60)]), at, word))
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield spark.createDataFrame(rows, "key int, at int, word string")
    spark.conf.set("spark.sql.shuffle.partitions", old)


def by_key(rows):
    out = {}
    for key, at, word in sorted(rows, key=lambda r: r[1]):
        out.setdefault(key, []).append((at, word))
    return out


def spread(df):
    """Rows of the fullest task and of the median one."""
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return sizes[-1], sizes[len(sizes) // 2]


def test_carried_sender(table, rows):
    got = intake.carried_sender(table, ["key"], ["at"], "word")
    assert got.columns == ["key", "at", "word", "sender_name"]
    want = {}
    for key, own in by_key(rows).items():
        name = None
        for at, word in own:
            name = name if word is None else word or None
            want[key, at] = name
    assert {(r["key"], r["at"]): r["sender_name"] for r in got.collect()} == want
    most, median = spread(got)
    assert most <= 2 * median


def test_runs(table, rows):
    want = {}
    for key, own in by_key(rows).items():
        run, last = 0, object()
        for at, word in own:
            run, last = run + (word != last), word
            want.setdefault((key, run), (word, []))[1].append(str(at))
    got = intake.runs(table, ["key"], ["at"], F.col("word"), F.col("at").cast("string"), ",")
    assert {(r["key"], r["run"]): (r["value"], r["n"], r["text"]) for r in got.collect()} == {k: (w, len(a), ",".join(a)) for k, (w, a) in want.items()}
    most, median = spread(scan.run_numbers(table, ["key"], ["at"], F.col("word"), "run"))
    assert most <= 2 * median
    last = {(r["key"], r["run"]) for r in intake.last_runs(got, ["key"]).collect()}
    greatest = {}
    for key, run in want:
        greatest[key] = max(run, greatest.get(key, 0))
    assert last == {(key, run) for key, run in want if run > greatest[key] - 30}


def test_last_runs_meet_in_part_only(table):
    """Each task keeps 30 runs of a key at most before a key's runs meet."""
    plan = intake.last_runs(intake.runs(table, ["key"], ["at"], F.col("word"), F.lit("")), ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_streaks(table, rows):
    want = {}
    for key, own in by_key(rows).items():
        n = 0
        for at, word in own:
            n = n + 1 if word == "error" else 0
            want[key, at] = n
    got = intake.streaks(table, ["key"], ["at"], F.col("word") == "error")
    assert {(r["key"], r["at"]): r["errors"] for r in got.collect()} == want
    most, median = spread(got)
    assert most <= 2 * median
    whole = intake.streaks(table, ["key"], ["at"], F.lit(True))  # a streak over all ranges
    assert whole.filter("key = 0").agg(F.max("errors")).first()[0] == ROWS // 2


def test_no_rows_and_ties(spark):
    none = spark.createDataFrame([], "key int, at int, word string")
    for df in (intake.carried_sender(none, ["key"], ["at"], "word"), intake.runs(none, ["key"], ["at"], F.col("word"), F.col("word")), intake.streaks(none, ["key"], ["at"], F.col("word") == "error")):
        assert df.count() == 0
    same = spark.createDataFrame([(1, 1, "a")] * 5, "key int, at int, word string")
    assert [r["n"] for r in intake.runs(same, ["key"], ["at"], F.col("word"), F.col("word")).collect()] == [5]
