"""Spans in texts that are very long or hold very many of them, and what the candidates' tests let pass."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.llm import private, secrets, spans


def test_candidates_lose_nothing(spark):
    """The test before a generator's pattern passes every text that the pattern matches in."""
    rnd = random.Random(11)
    bits = ["a", "bob", "7", "42", "2024", "AB12", "@", "(at)", "[at]", " at ", ".", "(dot)", "[dot]", " dot ", " ", "-", ":", "::", "(", ")", "fe80", "0000", "WXYZ", "x", "123-45-6789", "a1:b2:", "c3:4d:e5"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(3, 14))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for pattern, test in private._GENERATORS:
        lost = df.filter(F.col("text").rlike(pattern) & ~F.col("text").rlike(test))
        assert lost.count() == 0
        assert df.filter(F.col("text").rlike(pattern)).count() > 0


def test_spelled_addresses(spark):
    rows = [(1, "write to john at example.com today"), (2, "email anna (at) example.org please"), (3, "write to john at example.com today and @ nothing"), (4, "look at the. other one")]
    got = {r["doc_id"]: r["spans"] for r in private.private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "email_spelled" in got[1] and "email_spelled" in got[2] and "email_spelled:9:28" in got[3] and got[4] == ""


def test_recall_of_added_spans(spark):
    """Of personal data in sentences that no template has, nine in ten are found, and ordinary numbers left alone."""
    rnd = random.Random(12)
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    made = [
        lambda: ("phone_plain", f"you can call ({n(3)}) {n(3)}-{n(4)} before noon"), lambda: ("phone_plain", f"my phone: {n(3)}-{n(3)}-{n(4)} or the office"),
        lambda: ("identity", f"the ssn is {n(3)}-{n(2)}-{n(4)} on file"), lambda: ("email_spelled", f"mail peter{n(2)} at garden dot org soon"),
        lambda: ("account", f"pay to iban DE{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)} by friday"), lambda: ("ip6", f"reached 2001:db8:{n(4)}:{n(4)}:{n(4)}:{n(4)}:{n(4)}:{n(4)} again"),
    ]
    rows, want = [], {}
    for i in range(240):
        kind, text = made[i % len(made)]()
        rows.append((i, f"some words first. {text}"))
        want[i] = kind
    rows += [(1000 + i, f"in 19{n(2)} 20{n(2)} 20{n(2)} there were {n(2)} {n(2)} {n(2)} rows, version {n(2)}.{n(2)}.{n(3)}") for i in range(60)]
    got = {r["doc_id"]: r["spans"] for r in private.private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(kind in got[i] for i, kind in want.items()) >= 0.9 * len(want)
    assert sum(got[1000 + i] == "" for i in range(60)) >= 54


def test_overlaps_by_runs(spark):
    """Many spans are told apart as few are."""
    rnd = random.Random(13)

    def row(n):
        at, out = 0, []
        for _ in range(n):
            a = at + rnd.randrange(0, 4)
            at = a + rnd.randrange(1, 5)
            out.append((0, a, at, "x", "", ""))
        return out

    rows = [(i, row(rnd.choice([0, 3, 70, 500])), row(rnd.choice([0, 3, 70, 500]))) for i in range(40)]
    df = spark.createDataFrame(rows, f"i int, f {spans.SPAN}, t {spans.SPAN}")
    better = lambda a, b: (a["end"] - a["start"]) > (b["end"] - b["start"])
    got = df.select("i", spans.apart(F.col("f"), [F.col("t")]).alias("apart"), spans.best(F.col("f"), [F.col("t")], better).alias("best")).collect()
    for (i, f, t), r in zip(rows, sorted(got, key=lambda r: r["i"]), strict=True):
        meets = lambda c, t=t: [o for o in t if o[1] < c[2] and c[1] < o[2]]
        assert [tuple(x)[1:3] for x in r["apart"]] == [c[1:3] for c in f if not meets(c)]
        assert [tuple(x)[1:3] for x in r["best"]] == [c[1:3] for c in f if not any(o[2] - o[1] > c[2] - c[1] for o in meets(c))]


def test_replaced(spark):
    rnd = random.Random(14)
    for n in (0, 1, 50, 700):
        text = "".join(rnd.choice("abcé😀 ") for _ in range(5000))
        found = [(rnd.randrange(3), a, min(5000, a + rnd.randrange(1, 40)), "", "", "") for a in (rnd.randrange(4999) for _ in range(n))]
        gone = set(k for s in found for k in range(s[1], s[2]))
        df = spark.createDataFrame([(text, found)], f"text string, found {spans.SPAN}")
        got = df.select(spans.replaced(F.col("text"), F.col("found"), "*")).first()[0]
        merged = []
        for _, a, b, *_ in sorted(found, key=lambda s: s[1]):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want, at = "", 0
        for a, b in merged:
            want, at = want + text[at:a] + "*", b
        assert got == want + text[at:] and len(gone) <= 5000


@pytest.mark.parametrize("scan", [private.private_data, secrets.secret_scan])
def test_long_texts(spark, scan):
    """A megabyte in one run, and 20,000 spans in one text, take seconds."""
    rnd = random.Random(15)
    run = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1 << 20))
    many = " ".join(f"call (555) {i % 900 + 100}-{i % 9000 + 1000} u{i}@x.org token=abcdef{i} x{i:05d}Zx8Qv2LmPq9RtY7uWb3Kd5N{i}" for i in range(10_000))
    df = spark.createDataFrame([(1, run), (2, many)], "doc_id long, text string")
    scan(df.limit(0)).count()
    began = time.time()
    got = {r["doc_id"]: r["spans"] for r in scan(df).collect()}
    assert time.time() - began < 60
    assert got[2].count(":") >= 2 * 10_000 and re.fullmatch(r"([a-z_0-9]+:\d+:\d+,?)*", got[2])


def test_added_spans_plainly(spark):
    """All spans against a plain search: the same patterns, features written anew, and the same trees."""
    rnd = random.Random(16)
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    made = [
        lambda: f"call ({n(3)}) {n(3)}-{n(4)}", lambda: f"ssn {n(3)}-{n(2)}-{n(4)}", lambda: "anna (at) example (dot) org", lambda: "peter at garden.org", lambda: f"iban DE{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)}", lambda: f"2001:db8:{n(4)}:{n(4)}:{n(4)}::{n(2)}",
        lambda: f"in 19{n(2)} 20{n(2)}", lambda: f"total {n(3)} {n(3)} {n(3)}", lambda: "a@b.example", lambda: f"+49 {n(3)} {n(6)}", lambda: f"192.168.{rnd.randrange(256)}.1", lambda: "the é😀 word", lambda: "Telefon", lambda: f"$ {n(3)}.{n(3)}.{n(3)}", lambda: f"{n(4)}-{n(4)}-{n(4)}-{n(4)}",
    ]
    rows = [(i, rnd.choice([" ", ", ", ". ", " and "]).join(rnd.choice(made)() for _ in range(rnd.randrange(7)))) for i in range(250)]
    model = private.fit(spark)
    got = {r["doc_id"]: r["spans"] for r in private.private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def luhn(t):
        d = re.sub("[^0-9]", "", t)
        return 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0

    def features(kind, t, before, after):
        before, digits = before.lower(), re.sub("[^0-9]", "", t)
        word = lambda words: int(bool(re.search(rf"(?:^|[^a-z])(?:{words})[^a-z]*(?:[a-z]+[^a-z]+)?$", before)))
        tail = re.search("[0-9]+$", t)
        return {
            "kind": kind, "digits": len(digits), "length": len(t), "groups": len(re.split("[^0-9]+", t)), "brackets": int(bool(re.search(r"[\[(]", t))), "hyphens": t.count("-"), "dots": t.count("."),
            "marked": int(bool(re.search(r"(?i)@|[\[(](?:at|dot)[\])]", t))), "domain": int(bool(re.search(rf"(?i)(?:\.|dot)[)\]]? ?(?:{private._DOMAINS})$", t))), "lead": int(bool(re.search(r"^\(?0[1-9]", t))), "slash": int("/" in t), "year": int(bool(re.search(r"(?:^|[^0-9])(?:1[89]|20)[0-9]{2}(?:[^0-9]|$)", t))), "tail": len(tail.group()) if tail else 0,
            "letters": len(re.sub("[^A-Za-z]", "", t)), "phone_word": word(private._PHONE_WORDS), "mail_word": word(private._MAIL_WORDS), "id_word": word(private._ID_WORDS), "bank_word": word(private._BANK_WORDS),
            "glued": int(bool(re.match("[A-Za-z0-9.,/%-]", after))), "money": int(bool(re.search(r"[$€£#=/*]\s*$", before))),
        }

    for i, t in rows:
        base = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        base += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        base += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if luhn(m.group())]
        base += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        scored = []
        for k, (pattern, _) in enumerate(private._GENERATORS):
            found = list(re.finditer(pattern, t))
            for j, m in enumerate(found):
                if any(s < m.end() and m.start() < e for _, s, e in base):
                    continue
                start = max(found[j - 2].end() if j > 1 else 0, m.start() - 24)
                f = features(k, m.group(), t[start : m.start()], t[m.end() : m.end() + 2])
                margin = model.margin(np.array([[f[name] for name in model.names]], float))[0]
                p = 1 / (1 + np.exp(-(margin * model.slope + model.shift)))
                assert abs(p - private.LEAST) > 1e-9
                if p >= private.LEAST:
                    scored.append((-p, m.start(), k, m.end()))
        added = [x for x in scored if not any(y[1] < x[3] and x[1] < y[3] and y[:3] < x[:3] for y in scored)]
        names = private.BASE + private.ADDED
        want = [*base, *((len(private.BASE) + k, s, e) for _, s, k, e in sorted(added, key=lambda x: (x[2], x[1])))]
        assert got[i] == ",".join(f"{names[k]}:{s}:{e}" for k, s, e in want)
