"""The maintained index against a plain one over the final table, and what a batch leaves alone."""

import os
import random
import re
import sqlite3
import unicodedata
from math import log

import pytest

from kelpline.operators import search, text_index

SCHEMA = "key long, text string, deleted boolean, seq int"


def tokens(t):
    return re.findall(r"\w+", (t or "").lower().replace("_", " "))


def plain_bm25(table, words):
    every = {k: tokens(t) for k, t in table.items()}
    mean = sum(map(len, every.values())) / len(every)
    out = {}
    for w in set(words):
        df = sum(w in t for t in every.values())
        odds = log((len(every) - df + 0.5) / (df + 0.5))
        for k, t in every.items():
            tf = t.count(w)
            if tf:
                out[k] = out.get(k, 0) - (odds if odds > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
    return out


def plain_phrase(table, words):
    every = {k: tokens(t) for k, t in table.items()}
    found = {k: sum(t[i : i + len(words)] == words for i in range(len(t))) for k, t in every.items()}
    return {k: n for k, n in found.items() if n}


@pytest.fixture(scope="module")
def maintained(spark, tmp_path_factory):
    """An index after batches of inserts, updates and deletes with repeated and unknown keys, and the table that is left."""
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    rnd, table = random.Random(1), {}
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(vocabulary[min(59, int(rnd.expovariate(0.12)))] for _ in range(rnd.randrange(0, 40)))
    for batch in range(4):
        changes = []
        for seq in range(120 if batch == 0 else 40):
            key, kind = rnd.randrange(150), rnd.random()
            new = None if kind < 0.1 else text()
            deleted = batch > 0 and kind > 0.7
            changes.append((key, new, deleted, seq))
            if deleted:
                table.pop(key, None)
            else:
                table[key] = new
        changes.append((None, "w1", False, 999))
        df = spark.createDataFrame(changes, SCHEMA)
        assert text_index.apply_changes(df, path, batch, block=8, folder_bytes=1500)
        assert not text_index.apply_changes(df, path, batch, block=8)  # once only
    return path, table


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path.removeprefix("file://")) for f in names}


def test_same_as_rebuilt(spark, maintained):
    path, table = maintained
    assert text_index.size(spark, path) == (len(table), sum(len(tokens(t)) for t in table.values()) / len(table))
    every = {k: tokens(t) for k, t in table.items()}
    words = ["w0", "w3", "w21", "nowhere"]
    assert text_index.frequencies(spark, path, words) == {w: sum(w in t for t in every.values()) for w in words}
    got = {(r["key"], r["token"]): (r["tf"], r["length"]) for r in text_index.any_word(spark, path, words).collect()}
    assert got == {(k, w): (t.count(w), len(t)) for k, t in every.items() for w in words if w in t}
    for words in (["w0", "w1"], ["w0", "w0"], ["w2", "w0", "w2"], ["w0", "nowhere"]):
        assert {r["key"]: r["tf"] for r in text_index.phrase(spark, path, words).collect()} == plain_phrase(table, words)
    ranked = {r["key"]: r["rank"] for r in text_index.bm25(spark, path, ["w0", "w5", "w30"]).collect()}
    assert ranked == pytest.approx(plain_bm25(table, ["w0", "w5", "w30"]))


def test_top_without_scoring_all(spark, maintained):
    path, table = maintained
    for words, n in ((["w0", "w5", "w30"], 5), (["w40"], 3), (["w1"], 10_000), (["nowhere"], 5)):
        top = text_index.top_words(spark, path, words, n)
        want = sorted((r, k) for k, r in plain_bm25(table, words).items())[:n]
        assert [(r["key"], r["rank"]) for r in top.rows.collect()] == [(k, pytest.approx(r)) for r, k in want]
        assert top.read <= top.blocks
    assert text_index.top_words(spark, path, ["w0", "w5", "w30"], 5).read < text_index.top_words(spark, path, ["w0", "w5", "w30"], 5).blocks
    hits = plain_phrase(table, ["w0", "w1"])
    top = text_index.top_phrase(spark, path, ["w0", "w1"], 4)
    assert len(top.rows.collect()) == min(4, len(hits)) and {r["key"] for r in top.rows.collect()} <= set(hits)


def test_segments_stay_and_compact(spark, maintained):
    """A batch leaves files of other segments as they are; a failed one is written over; a compacted index answers alike and goes on."""
    path, table = maintained
    before = files(path)
    change = spark.createDataFrame([(1, "w0 fresh", False, 0), (7_000, None, True, 0)], SCHEMA)
    with pytest.raises(ZeroDivisionError):
        text_index.apply_changes(change, path, 4, block=8, folder_bytes=0)  # fails between its files
    assert text_index.size(spark, path)[0] == len(table)
    assert text_index.apply_changes(change, path, 4, block=8, folder_bytes=1500)
    after = files(path)
    assert {f: t for f, t in after.items() if f in before} == before
    table = table | {1: "w0 fresh"}
    assert text_index.compact(spark, path, block=8) == 5
    assert len(text_index.segments(spark, path)) == 1
    assert text_index.size(spark, path) == (len(table), sum(len(tokens(t)) for t in table.values()) / len(table))
    ranked = {r["key"]: r["rank"] for r in text_index.bm25(spark, path, ["fresh", "w0"]).collect()}
    assert ranked == pytest.approx(plain_bm25(table, ["fresh", "w0"]))
    assert not text_index.apply_changes(change, path, 4)
    assert text_index.apply_changes(spark.createDataFrame([(1, None, True, 0)], SCHEMA), path, 5)
    assert text_index.any_word(spark, path, ["fresh"]).count() == 0


def test_empty_index(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert text_index.size(spark, path) == (0, 0.0) and text_index.any_word(spark, path, ["a"]).count() == 0
    assert text_index.apply_changes(spark.createDataFrame([], SCHEMA), path, 0)
    assert text_index.bm25(spark, path, ["a"]).count() == 0 and text_index.top_words(spark, path, ["a"], 5).rows.count() == 0


def test_folding_of_marks(spark):
    """Every letter of the Latin blocks folds as in SQLite's full-text tables; Cyrillic keeps its marks."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(x)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text tables in this SQLite")
    con.execute("create virtual table v using fts5vocab(t, 'row')")
    letters = [chr(c) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00), (0x410, 0x460)) for c in range(a, b) if chr(c).isalpha()] + ["café", "ŁÓDŹ", "žluťoučký", unicodedata.normalize("NFD", "Āž")]
    rows = {r["c"]: r["t"] for r in spark.createDataFrame([(c,) for c in letters], "c string").select("c", search.tokens_of("c").alias("t")).collect()}
    for c in letters:
        con.execute("delete from t")
        con.execute("insert into t values (?)", (c,))
        assert rows[c] == [r[0] for r in con.execute("select term from v")], c
