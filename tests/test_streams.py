import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.functions.phash import phash, with_phash
from kelpline.sources import readers
from kelpline.streaming import jobs

SCHEMA = "id long, chat long, file string, valid boolean, created_at timestamp"


@pytest.fixture()
def events(spark, tmp_path):
    rows = [(1, 1, "f", False, "2024-01-01 10:00:00"), (2, 1, "f", True, "2024-01-01 10:01:00"), (3, 1, "f", True, "2024-01-01 10:02:00"), (4, 2, "f", True, "2024-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "id long, chat long, file string, valid boolean, t string").select("id", "chat", "file", "valid", F.to_timestamp("t").alias("created_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return jobs.files(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path)


def test_rejected_doesnt_bar(events):
    df, path = events
    got = jobs.run_to_end(jobs.first_valid(df, ["chat", "file"], F.col("valid"), "created_at"), f"{path}/o1", f"{path}/c1")
    rows = sorted((r["chat"], r["id"]) for r in got.collect())
    assert [c for c, _ in rows] == [1, 2] and rows[0][1] in (2, 3)


def test_last_and_daily(events):
    df, path = events
    last = jobs.run_to_end(jobs.last_of_key(df, "chat", "created_at", "id"), f"{path}/o2", f"{path}/c2", "update")
    assert sorted((r["chat"], r["id"]) for r in last.collect()) == [(1, 3), (2, 4)]
    days = jobs.once_a_day(df.select("chat", F.date_format("created_at", "yyyy-MM-dd").alias("day")), "chat", "day")
    assert sorted(map(tuple, jobs.run_to_end(days, f"{path}/o3", f"{path}/c3").collect())) == [(1, "2024-01-01"), (2, "2024-01-02")]


def test_late_stay_in_history(spark, events):
    df, path = events
    seen = []
    q = jobs.record_and_process(df, f"{path}/history", f"{path}/c4", lambda batch, _: seen.append(batch.count()))
    q.awaitTermination()
    assert spark.read.parquet(f"{path}/history").count() == 4 and sum(seen) == 0


def test_sessions(events):
    df, path = events
    kind = F.when(F.col("id") == 1, "open").when(F.col("id") == 3, "close").otherwise("x")
    s = jobs.sessions(df.select("chat", "id", kind.alias("kind")), "chat", "id", "kind")
    assert [tuple(r) for r in jobs.run_to_end(s, f"{path}/o5", f"{path}/c5").collect()] == [(1, 0, 1, 3)]


def test_restart_late_rows_and_expiry(spark, tmp_path):
    """State goes on after restarts, late rows don't undo later ones, and a key that nothing comes for is forgotten."""
    land, out = str(tmp_path / "in"), {}

    def batch(k, rows):
        spark.createDataFrame(rows, "key int, at long, what string").coalesce(1).write.parquet(f"{land}/{k}")
        df = jobs.files(spark, f"{land}/*", "key int, at long, what string")
        jobs_of = {
            "sessions": (jobs.sessions(df, "key", "at", "what"), "append"),
            "last": (jobs.last_of_key(df, "key", "at", "what"), "update"),
            "first": (jobs.first_arrival(df, ["key"], ["at"]), "append"),
            "soon": (jobs.first_arrival(df, ["key"], ["at"], keep="1 second"), "append"),
        }
        for name, (job, mode) in jobs_of.items():
            out[name] = jobs.run_to_end(job, str(tmp_path / name), str(tmp_path / f"{name}_state"), mode)

    batch(0, [(1, 10, "open"), (2, 11, "x"), (1, 12, "x")])
    time.sleep(1)
    batch(1, [(1, 5, "x"), (1, 20, "close"), (2, 21, "open")])
    time.sleep(1)
    batch(2, [(2, 3, "close"), (1, 30, "open"), (3, 31, "x")])
    assert sorted(map(tuple, out["sessions"].collect())) == [(1, 0, 10, 20), (2, 0, 21, 3)]
    assert {(r["key"], r["at"]): r["batch"] for r in out["last"].collect()} == {(1, 12): 0, (2, 11): 0, (1, 20): 1, (2, 21): 1, (1, 30): 2, (3, 31): 2}
    assert sorted(map(tuple, out["first"].collect())) == [(1, 10), (2, 11), (3, 31)]
    assert sorted(map(tuple, out["soon"].collect())) == [(1, 5), (1, 10), (1, 30), (2, 3), (2, 11), (2, 21), (3, 31)]


def test_routes(spark):
    df = spark.createDataFrame([(1.0, "p", None, "t"), (None, "p", "v", "t"), (None, None, "v", "t"), (None, None, None, "t"), (None, None, None, None)], "latitude double, photo_file_id string, voice_file_id string, message_text string")
    assert {k: v.count() for k, v in jobs.routes(df).items()} == {"location": 1, "photo": 1, "voice": 1, "text": 1}


def _picture(seed, width=40, height=30):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def test_phash(spark):
    a, b = _picture(1), _picture(2)
    brighter = np.clip(a.astype(int) + 3, 0, 255).astype(np.uint8)
    h = [phash(40, 30, 3, x.tobytes()) for x in (a, brighter, b)]
    near = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert near(h[0], h[1]) <= 4 < near(h[0], h[2])
    df = spark.createDataFrame([((40, 30, 3, bytearray(a.tobytes())),), ((-1, -1, -1, bytearray()),)], "image struct<width:int,height:int,nChannels:int,data:binary>")
    assert [r["phash"] for r in with_phash(df).collect()] == [h[0], None]


def test_landed_searches(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"offset": 0, "endOfRecords": true, "results": [{"key": 1, "species": "s", "media": []}]}\n{"offset": 300, "endOfRecords": true, "results": [{"key": 2}]}\n')
    assert [r["key"] for r in readers.occurrences(spark, str(tmp_path / "o.json")).collect()] == [1]
    (tmp_path / "w.json").write_text('{"latitude": 1.0, "longitude": 2.0, "daily": {"time": ["a", "b"], "weathercode": [61, 0], "precipitation_sum": [1.0, 0.0]}}')
    assert sorted((r["time"], r["weathercode"]) for r in readers.weather(spark, str(tmp_path / "w.json")).collect()) == [("a", 61), ("b", 0)]
    done = spark.createDataFrame([("x",)], "cache_key string")
    known, new = readers.cached(spark.createDataFrame([("p",)], "path string"), done, F.col("path"), "1", "b")
    assert known.count() == 0 and len(new.first()["cache_key"]) == 20


def test_file_scans(spark, tmp_path):
    for name in ("pike/a.jpg", "pike/b.TXT", "carp/c.PNG"):
        p = tmp_path / "img" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"not an image")
    assert sorted((r["cls"], r["stem"]) for r in readers.images(spark, str(tmp_path / "img")).collect()) == [("carp", "c"), ("pike", "a")]
    sizes = {r["filename"]: r["width"] for r in readers.image_sizes(spark, str(tmp_path / "img" / "pike")).collect()}
    assert sizes["a.jpg"] == -1
    for n, text in (("messages2.html", "two"), ("messages.html", "one"), ("base.html", "x")):
        (tmp_path / n).write_text(text)
    assert [r["html"] for r in readers.pages(spark, str(tmp_path)).orderBy("page").collect()] == ["one", "two", "x"]
