"""Pages of a service and of a folder, archives by their directory, sizes from the heads of images."""

import json
import os
import random
import struct
import threading
import zipfile
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from kelpline.sources import paged, readers
from kelpline.streaming import jobs


@pytest.fixture()
def service():
    """A service of records, which fails the first time that it is asked for some pages, and what it was asked for."""

    class Handler(BaseHTTPRequestHandler):
        records, asked, failing = [], [], {20, 40}

        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            Handler.asked.append((q["offset"], q["limit"]))
            if q["offset"] in Handler.failing:
                Handler.failing.discard(q["offset"])
                self.send_error(503)
                return
            some = Handler.records[q["offset"] : q["offset"] + q["limit"]]
            body = json.dumps({"offset": q["offset"], "count": len(Handler.records), "endOfRecords": q["offset"] + q["limit"] >= len(Handler.records), "results": some}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Handler, f"http://127.0.0.1:{server.server_port}/search"
    server.shutdown()


def record(k):
    return {"key": k, "species": f"s{k % 3}", "media": None if k % 4 == 0 else [{"type": "StillImage", "identifier": f"http://x/{k}", "license": "c"}]}


def test_service_in_batch_and_stream(spark, tmp_path, service):
    handler, address = service
    handler.records[:] = [record(k) for k in range(70)]
    got = paged.read(spark, address, limit="10", pages="2")
    assert got.rdd.getNumPartitions() == 4
    rows = {r["key"]: r for r in got.collect()}
    assert sorted(rows) == list(range(70)) and rows[4]["media"] is None and rows[5]["media"][0]["identifier"] == "http://x/5" and rows[69]["endOfRecords"]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    jobs.run_to_end(paged.stream(spark, address, limit="10"), out, state)
    handler.records += [record(k) for k in range(70, 100)]
    handler.asked.clear()
    found = jobs.run_to_end(paged.stream(spark, address, limit="10"), out, state)
    assert sorted(r["key"] for r in found.collect()) == list(range(100))
    assert {o for o, limit in handler.asked if limit == 10} == {70, 80, 90}  # none of the first run's pages again


def test_service_that_stays_away(spark, service):
    handler, address = service
    handler.records[:] = [record(1)]
    handler.failing.add(0)
    with pytest.raises(Exception, match="503"):
        paged.read(spark, address, attempts="1").collect()


def test_folder_without_pages(spark, tmp_path):
    assert paged.read(spark, str(tmp_path / "none")).count() == 0


def test_archive_over_many_tasks(spark, tmp_path):
    """One archive of a thousand entries is unpacked by several tasks; broken archives have no rows."""
    rnd = random.Random(4)
    want = {f"d/{k}.txt": rnd.randbytes(rnd.randrange(0, 3000)) for k in range(1000)}
    with zipfile.ZipFile(tmp_path / "a b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("d")
        for name, content in want.items():
            z.writestr(name, content)
    (tmp_path / "broken.zip").write_bytes(b"PK not an archive")
    got = readers.zip_entries(spark, str(tmp_path), task_bytes=100_000)
    assert {(r["archive"], r["entry"]): bytes(r["content"]) for r in got.collect()} == {("a b.zip", n): c for n, c in want.items()}
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 8 and max(sizes) < 250


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_sizes_from_heads(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 70, 50, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 71 * 50)) + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 16) + b"J" * 14 + b"\xff\xc4" + struct.pack(">H", 4) + b"hh" + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, 480, 640, 1) + b"\x01\x11\0" + b"data\xff\xd9"
    gif = b"GIF89a" + struct.pack("<HH", 30, 20) + b"\0\0\0;"
    bmp = b"BM" + struct.pack("<IIIIii", 60, 0, 54, 40, 12, -9) + b"\0" * 34
    webp = b"VP8X" + struct.pack("<I", 10) + b"\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    webp = b"RIFF" + struct.pack("<I", len(webp) + 4) + b"WEBP" + webp
    lossless = b"VP8L" + struct.pack("<I", 5) + b"\x2f" + (41 | 22 << 14).to_bytes(4, "little")
    lossless = b"RIFF" + struct.pack("<I", len(lossless) + 4) + b"WEBP" + lossless
    want = {"a.png": (png, 70, 50), "b.jpg": (jpeg, 640, 480), "c.gif": (gif, 30, 20), "d.bmp": (bmp, 12, 9), "e.webp": (webp, 100, 50), "f.webp": (lossless, 42, 23), "g.jpg": (jpeg[:-3], -1, -1), "h.png": (png[:40], -1, -1), "j.png": (b"no image", -1, -1)}
    for name, (content, _, _) in want.items():
        (tmp_path / name).write_bytes(content)
    got = readers.image_sizes(spark, str(tmp_path))
    assert {r["filename"]: (bytes(r["content"]), r["width"], r["height"]) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan") == 1
    assert os.path.isdir(tmp_path)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_clusters_from_image_files(spark):
    """The cluster rows of the pictures against all pairs of their hashes."""
    from kelpline.plans.registry import QUERIES

    hashes = {r["filename"]: r["phash"] for r in QUERIES["image_hashes"](spark, "/root/testdata/sf0.001").collect() if r["phash"] is not None}
    root = {f: f for f in hashes}
    for a in sorted(hashes):
        for b in sorted(hashes):
            if a < b and ((hashes[a] ^ hashes[b]) & (1 << 64) - 1).bit_count() <= 8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {f: new if r == old else r for f, r in root.items()}
    members = {}
    for f, r in root.items():
        members.setdefault(r, set()).add(f)
    rows = QUERIES["image_clusters"](spark, "/root/testdata/sf0.001").collect()
    got = {}
    for r in rows:
        got.setdefault(r["cluster_id"], set()).add(r["filename"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(m) for m in members.values() if len(m) > 1)
    assert sum(r["keep"] for r in rows) == len(got) > 0
