import random

import pytest

from pyspark.sql import functions as F

from kelpline.operators import clusters, curation, evaluation, intake, search
from kelpline.sources import html_export, readers, sinks


def _page(*messages):
    return "<html><body>" + "".join(messages) + "</body></html>"


def _message(number, photo=None, name=None, text="", date="25.12.2017 19:47:37 UTC+03:00", joined=False):
    head = f'<div class="from_name"> {name} </div>' if name is not None else ""
    link = f'<a class="photo_wrap clearfix" href="{photo}"><img src="{photo}"></a>' if photo else ""
    return f'<div class="message default clearfix{" joined" * joined}" id="message{number}"><div class="body"><div class="date" title="{date}">x</div>{head}{link}<div class="text">{text}</div></div></div>'


def test_manifest(spark):
    one = _page(_message(1, "photos/1.jpg", "Ann", "a <b>b</b>"), _message(2, "photos/2.jpg", joined=True), _message(3, "photos/t_thumb.jpg"), _message(4, None, ""), _message(5, "photos/9.jpg", joined=True))
    two = _page(_message(6, "photos/2.jpg", "Bob"), _message(7, "photos/3.jpg", date="bad"))
    pages = spark.createDataFrame([(1, one), (2, two)], "page int, html string")
    records, later = html_export.manifest(pages, "tg", "own")
    got = {r["filename"]: r for r in records.collect()}
    assert sorted(got) == ["photos/1.jpg", "photos/2.jpg", "photos/3.jpg", "photos/9.jpg"]
    assert (got["photos/1.jpg"]["sender_name"], got["photos/2.jpg"]["sender_name"], got["photos/9.jpg"]["sender_name"]) == ("Ann", "Ann", None)
    assert got["photos/1.jpg"]["timestamp"] == 1514220457 and got["photos/3.jpg"]["timestamp"] is None
    assert got["photos/1.jpg"]["caption"] == "ab" and got["photos/2.jpg"]["msg_id"] == 2
    assert [r["filename"] for r in later.collect()] == ["photos/2.jpg"]
    s = intake.manifest_summary(records, intake.photo_refs(pages), later).first()
    assert (s["records"], s["duplicate_refs"], s["candidates"], s["raw_refs"], s["thumbs"]) == (4, 1, 5, 5, 1)
    present = spark.createDataFrame([("photos/1.jpg",)], "filename string")
    assert html_export.manifest(pages, "tg", "own", present)[0].filter("parse_error").count() == 3


def test_side_histogram(spark):
    df = spark.createDataFrame([(1280,), (800,), (400,), (399,), (None,)], "max_side int")
    assert {r["bucket"]: r["n"] for r in intake.side_histogram(df).collect()} == {"ge_1280": 1, "800_1279": 1, "400_799": 1, "lt_400": 1}


def test_audit_record(spark):
    df = spark.createDataFrame([("a", bytearray(b"xx"), 900, 700), ("b", bytearray(b"yy"), -1, -1), ("c", None, None, None), ("d", bytearray(b"z"), 10, 20)], "filename string, content binary, width int, height int")
    r = {x["filename"]: x for x in intake.audit_record(df).collect()}
    assert (r["a"]["max_side"], r["a"]["low_res"], r["a"]["corrupt"]) == (900, False, False)
    assert r["b"]["corrupt"] and r["b"]["sha256"] and not r["b"]["low_res"]
    assert r["c"]["corrupt"] and r["c"]["sha256"] is None and r["c"]["file_size"] is None
    assert r["d"]["low_res"]


def _codes(spark, *codes):
    return spark.createDataFrame(list(enumerate(codes)), "idx long, h long")


def test_near_pairs(spark):
    pairs = lambda t, *c: sorted(tuple(r) for r in clusters.near_pairs(_codes(spark, *c), "idx", "h", t).collect())
    assert pairs(8, 0x0, 0xF) == [(0, 1, 4)]
    assert pairs(8, 0x0, 0xFFF) == [] and pairs(12, 0x0, 0xFFF) == [(0, 1, 12)]
    assert pairs(0, 5, 5, -1) == [(0, 1, 0)]
    assert pairs(1, -1, -2) == [(0, 1, 1)]


def test_near_pairs_in_blocks(spark):
    """All pairs at a distance at which bands are too short, in more rows than one block holds."""
    rnd = random.Random(3)
    codes = [rnd.randrange(-(2**63), 2**63) for _ in range(60)]
    codes += [c ^ (1 << 63) - 1 & sum(1 << rnd.randrange(63) for _ in range(k % 25)) for k, c in enumerate(codes)] + [codes[0]] * 3
    head = {c: codes.index(c) for c in codes}
    apart = lambda x, y: ((x ^ y) % 2**64).bit_count()
    want = [(i, j, apart(x, y)) for x, i in head.items() for y, j in head.items() if i < j and apart(x, y) <= 18]
    want += [(head[c], i, 0) for i, c in enumerate(codes) if i > head[c]]
    for block in (7, 2000):
        got = clusters.near_pairs_in_blocks(_codes(spark, *codes), "idx", "h", 18, block)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("how", [(1, 8), (2, 4), (3, 2), (9, 0), None])
def test_near_pairs_by_bands(spark, how):
    """Exact at 8 of 64 bits by any number of bands, also with a large group of near codes."""
    rnd = random.Random(4)
    base = [rnd.randrange(-(2**63), 2**63) for _ in range(12)]
    codes = base + [c ^ sum(1 << rnd.randrange(63) for _ in range(k % 11)) for k, c in enumerate(base * 3)]
    codes += [base[0] ^ (1 << k) for k in range(20)] + [base[1]] * 3
    head = {}
    for i, c in enumerate(codes):
        head.setdefault(c, i)
    apart = lambda x, y: ((x ^ y) % 2**64).bit_count()
    want = [(min(i, j), max(i, j), apart(x, y)) for x, i in head.items() for y, j in head.items() if x < y and apart(x, y) <= 8]
    want += [(head[c], i, 0) for i, c in enumerate(codes) if i > head[c]]
    if how and how[1] > 4:
        how = (2, 4)  # the neighbours of a whole code are too many for a test
    got = clusters.near_pairs(_codes(spark, *codes), "idx", "h", 8, how=how)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_band_plan():
    """Beyond some codes bands make less work than blocks, and far less at size; at 18 of 64 bits blocks remain."""
    assert clusters.plan_bands(1000, 64, 8) is None or clusters.plan_bands(1000, 64, 8)[0] > 1
    bands, inside = clusters.plan_bands(100_000_000, 64, 8)
    assert bands * (inside + 1) > 8 and bands <= 4
    assert clusters.plan_bands(10_000, 64, 18) is None


def test_exact_keep(spark):
    df = spark.createDataFrame([("b", "h", None, 5), ("a", "h", 42, 5), ("c", "g", 1, 5), ("d", None, 2, 5), ("e", None, 3, 5)], "filename string, sha256 string, msg_id long, max_side int")
    c = clusters.clustered(df, "sha256", "filename", clusters.exact_order(), "exact")
    assert sorted((r["cluster_id"], r["filename"], r["keep"]) for r in c.collect()) == [(1, "a", True), (1, "b", False)]
    r = clusters.as_lists(c.join(df, "filename"), clusters.exact_order()).first()
    assert (r["keep_filename"], r["duplicate_filenames"]) == ("a", ["b"])


def test_conflicts(spark):
    schema = "cluster_id int, cluster_type string, filename string, keep boolean"
    pair = lambda i, kind, keep, other: [(i, kind, keep, True), (i, kind, other, False)]
    exact = spark.createDataFrame(pair(1, "exact", "a", "b") + pair(2, "exact", "k", "m") + pair(3, "exact", "x", "y"), schema)
    near = spark.createDataFrame([(*r, 8) for r in pair(4, "perceptual", "k", "a")], schema + ", hamming_distance int")
    rows = clusters.resolved(exact, near)
    assert sorted((r["cluster_id"], r["filename"], r["keep"]) for r in rows.collect()) == [(3, "x", True), (3, "y", False), (4, "a", False), (4, "b", False), (4, "k", True), (4, "m", False)]
    s = clusters.dedup_summary(rows, spark.range(20), 8).first()
    assert (s["exact_clusters"], s["perceptual_duplicates"], s["boundary_clusters"], s["unique_files"]) == (1, 3, 1, 16)


def test_split_sizes(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 3, "few").otherwise("many").alias("c"))
    s = curation.stratified_split(df, "c", "id")
    n = {(r["c"], r["split"]): r["n"] for r in curation.class_counts(s, "c", "split").collect()}
    assert n == {("few", "train"): 2, ("few", "val"): 1, ("many", "train"): 67, ("many", "val"): 14, ("many", "test"): 16} or n[("many", "train")] == 67
    assert s.count() == 100 and s.select("id").distinct().count() == 100


def test_labels(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 1.0 1.0\n9 0.5 0.5 1 1\nx 1 1 1 1\n0 1 1\n0 0.5 0.5 2 1\n\n0 a 0.5 1 1\n")
    e = curation.label_errors(readers.label_lines(spark, str(tmp_path)), "stem", "line", "value", 5)
    assert sorted((r["line"], r["error"]) for r in e.collect()) == [(1, "class out of range"), (2, "class not a number"), (3, "fields"), (4, "out of [0, 1]"), (6, "not a number")]


def test_matrix_drops_unknown(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "error_x"), ("z", "a")], "t string, p string")
    cells = evaluation.confusion(df, "t", "p", ["a", "b"])
    m = {r["cls"]: (r["precision"], r["recall"], r["support"]) for r in evaluation.per_class(cells).collect()}
    assert m == {"a": (1.0, 0.5, 2), "b": (0.0, 0.0, 0)}
    empty = evaluation.confusion(df.limit(0), "t", "p", ["a", "b"])
    assert evaluation.all_passed(evaluation.gates([evaluation.worst_class_gate(evaluation.per_class(empty), 0.7, ())])).first()["all_passed"]


def test_search(spark):
    df = spark.createDataFrame([(1, "Рыба РЫБА café"), (2, "рыбак cafe"), (3, "ёлка елка")], "id long, t string")
    ids = lambda *w: sorted({r["id"] for r in search.any_word(df, "id", "t", list(w)).collect()})
    assert ids("рыба") == [1] and ids("cafe") == [1, 2] and ids("ёлка") == [3] and ids("елка") == [3]
    assert [tuple(r) for r in search.phrase(df, "id", "t", ["рыба", "рыба"]).collect()] == [(1, 1, 3)]


def test_stored_index(spark, tmp_path):
    """The same from the stored index as from the documents; places of a phrase may overlap."""
    df = spark.createDataFrame([(1, "a a a, b"), (2, "b a"), (3, "x"), (4, None), (5, "a a")], "id long, t string")
    search.write_index(df, "id", "t", str(tmp_path / "ix"))
    for words in (["a", "a"], ["b"], ["b", "a"], ["q"]):
        want = sorted(map(tuple, search.phrase(df, "id", "t", words).collect()))
        got = search.indexed_phrase(spark, str(tmp_path / "ix"), words).select("key", "tf", "length")
        assert sorted(map(tuple, got.collect())) == want
    assert [r["tf"] for r in search.phrase(df, "id", "t", ["a", "a"]).orderBy("id").collect()] == [2, 1]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b/x.txt", b"one"), ("y.txt", None)], "path string, content binary")
    assert sorted(map(tuple, sinks.files(df, str(tmp_path / "f"), dry_run=True).collect())) == [("a/b/x.txt", 3), ("y.txt", 0)]
    assert not (tmp_path / "f").exists()
    assert sinks.files(df, str(tmp_path / "f")).count() == 2 and (tmp_path / "f/a/b/x.txt").read_bytes() == b"one" and (tmp_path / "f/y.txt").read_bytes() == b""


def test_readers(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,cls,url\n1,fish,"a\n2,b\n3,c,d,e\n')
    assert sorted(tuple(r) for r in readers.naive_csv(spark, str(tmp_path / "x.csv"), ["id", "cls", "url"]).collect()) == [("1", "fish", '"a'), ("3", "c", "d")]
    assert readers.yaml_names("nc: 2\nnames: ['a', \"b\"]\n") == ["a", "b"] == readers.yaml_names("names:\n  - a\n  - b\n") == readers.yaml_names("names:\n  0: a\n  1: b\n")
    (tmp_path / "m.json").write_text('{"f.jpg": {"photo_id": 3, "source": "s"}}')
    assert tuple(readers.nested_map(spark, str(tmp_path / "m.json"), "filename", "photo_id:bigint,source:string").first()) == ("f.jpg", 3, "s")
    sinks.json_lines(spark.createDataFrame([("f", None)], "filename string, msg_id long"), str(tmp_path / "out"))
    assert readers.json_lines(spark, str(tmp_path / "out"), "manifest").first()["filename"] == "f"
    sinks.json_lines(spark.range(1), str(tmp_path / "no"), dry_run=True)
    assert not (tmp_path / "no").exists()
    old = spark.createDataFrame([(1, "old")], "chat_id long, body string")
    m = readers.legacy(spark, [old], "messages", {"message_text": ["text", "body"]}).first()
    assert (m["message_text"], m["message_type"]) == ("old", "text")


def test_streaks_and_runs(spark):
    df = spark.createDataFrame([(1, 1, "e"), (1, 2, "e"), (1, 3, "ok"), (1, 4, "e")], "u long, i long, k string")
    s = {r["i"]: r["errors"] for r in intake.streaks(df, ["u"], ["i"], F.col("k") == "e").collect()}
    assert s == {1: 1, 2: 2, 3: 0, 4: 1}
    r = sorted((x["run"], x["value"], x["n"], x["text"]) for x in intake.runs(df, ["u"], ["i"], F.col("k"), F.col("i").cast("string"), "+").collect())
    assert r == [(1, "e", 2, "1+2"), (2, "ok", 1, "3"), (3, "e", 1, "4")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)]
    hub = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(chain + hub + [(7, 7), (200, 199)], "a long, b long")
    got = {r["node"]: r["component"] for r in clusters.near_clusters(edges.withColumn("distance", F.lit(1))).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 160)) and got[200] == 199
    assert clusters.near_clusters(edges.limit(0)).count() == 0


def test_numbers(spark):
    from kelpline.operators.order import numbered

    df = spark.createDataFrame([(f"{(i * 37) % 101:03d}",) for i in range(101)], "name string")
    got = sorted((r["n"], r["name"]) for r in numbered(df, "name", "n").collect())
    assert got == [(i + 1, f"{i:03d}") for i in range(101)]


def test_budget_by_conversation(spark):
    turns = [(c, i, "system" if i == 0 else "user", "x" * n) for c, n in ((1, 10), (2, 2)) for i in range(4)]
    df = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    got = search.within_budget(df, "text", "role", "turn", 20, 1, by=["conv_id"]).collect()
    assert sorted((r["conv_id"], r["turn"]) for r in got) == [(1, 0), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3)]
