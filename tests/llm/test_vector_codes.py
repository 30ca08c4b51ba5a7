"""Vector codes against a plain version in Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from kelpline.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, ids string, _of string"


def plain(rows, entries=256, rounds=4):
    """(vec_id, code, error) of the rows that can be coded, and the codebooks' numbers."""
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in e], label) for i, e, label in rows if e and all(x is not None and math.isfinite(x) for x in e) and len(e) == 8]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [tuple(v[p * 2 : p * 2 + 2]) for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in fine[:entries]] for p in range(4)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(4):
            members = {}
            for _, v, _ in fine:
                members.setdefault(nearest(p, cut(v)[p])[1], []).append(cut(v)[p])
            new.append([tuple(sum(c) // len(members[k]) for c in zip(*members[k], strict=True)) if k in members else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, v, label in fine:
        best = [nearest(p, cut(v)[p]) for p in range(4)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, [x for p in books for e in p for x in e]


def rows_of(n, seed):
    rnd = random.Random(seed)
    rows = [(k, [round(rnd.gauss(0, 0.3), 2) for _ in range(8)], rnd.choice([1, 1, 1, 2, None])) for k in range(n)]
    return rows + [
        (None, [0.5] * 8, 3), (None, None, 1), (3, [1.0] * 8, None), (3, [1.0] * 8, None), (-5, [-0.0001] * 8, 2), (7, [0.1] * 7 + [None], 1), (8, [float("nan")] + [0.0] * 7, 1), (9, [0.0] * 7 + [float("inf")], 1),
        (10, [], 1), (11, [0.1] * 4, 1), (12, [0.1] * 7, 1), (13, [9e4, -3.0] * 4, 1),
    ]


@pytest.mark.parametrize("n, block", [(20, 4096), (700, 64)])
def test_against_plain(spark, monkeypatch, n, block):
    """Fewer vectors than entries, and many blocks; with null, unfit and repeated rows and huge components."""
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = rows_of(n, n)
    capped = [(i, e and [x if x is None or not math.isfinite(x) else max(-65536.0, min(65536.0, x)) for x in e], label) for i, e, label in rows]
    want, numbers = plain(capped)
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    got, books = vector_codes.vector_codes(df)
    assert books.ravel().tolist() == numbers
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_query_columns(spark, tmp_path):
    rows = rows_of(60, 1)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    capped = [(i, e and [x if x is None or not math.isfinite(x) else max(-65536.0, min(65536.0, x)) for x in e], label) for i, e, label in rows]
    want, numbers = plain(capped)
    totals = {}
    for _, label, _, error in want:
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    got = vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, c, e, totals[label], digest) for i, label, c, e in want), key=repr)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")] * 8, 1)]):
        got, books = vector_codes.vector_codes(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA))
        assert got.collect() == [] and not books.size


def test_narrow_and_wide_numbers_agree():
    rng = np.random.default_rng(3)
    for most in (50, 5000, 1 << 26):
        x, e = rng.integers(-most, most, (16, 900)), rng.integers(-most, most, (256, 16))
        e[7] = e[3]  # a tie goes to the lower number
        found, far = vector_codes.nearest(x, e)
        d = ((x.T[:, None, :].astype(object) - e[None].astype(object)) ** 2).sum(2) if most > 5000 else ((x.T[:, None, :] - e[None]) ** 2).sum(2)
        d = np.array(d, np.int64)
        assert (found == d.argmin(1)).all() and (far == d.min(1)).all()
