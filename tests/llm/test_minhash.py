"""Near duplicates by two-word shingles against all pairs compared exactly."""

import random
import re

import numpy as np
import pytest

from kelpline.llm import minhash

HARD = [(None, None), (None, "no id here at all"), (1, ""), (1, ""), (2, None), (3, "   \n\t"), (4, "one"), (5, "two words"), (5, "Two  words"), (6, "two words"), (7, "word " * 9000), (8, "ONE"), (9, "é😀 ñandú ÀB"), (10, "é😀 ñandú àb")]
SCHEMA = "doc_id long, text string, bucket string, node string, payload string, key string, weight string, mark string, kept string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


def shingled(text):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(ws[i : i + 2]) for i in range(len(ws) - 1)} if len(ws) > 1 else set(ws)


def plain(rows):
    """doc_id, n_shingles, component_id and kept of all rows, from all pairs."""
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in holders.setdefault(g, []):
                shared[j] = shared.get(j, 0) + 1
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i, i == (least.get(find(k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def word(rnd):
    return "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8)))


def families(seed, n=14):
    """Bases with scattered, appended and replaced words, short texts too, and chains of small edits."""
    rnd = random.Random(seed)
    rows, k = [], 100
    for f in range(n):
        size = rnd.choice([3, 5, 6, 11, 40, 150, 600])
        base = [word(rnd) for _ in range(size)]
        for _ in range(9):
            copy, kind, edits = list(base), rnd.randrange(4), rnd.randrange(max(2, size // 8) + 1)
            if kind == 0:
                for _ in range(edits // 2):
                    copy[rnd.randrange(size)] = word(rnd)
            elif kind == 1:
                copy += [word(rnd) for _ in range(edits)]
            elif kind == 2 and edits:
                copy[-edits:] = [word(rnd) for _ in range(edits)]
            rows.append((k, " ".join(copy)))
            k += rnd.randrange(3)  # also repeated ids
            if f % 3 == 0:
                base = copy[:size] + base[len(copy) :]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"rows": 6, "most": 500}])
def test_against_all_pairs(spark, how):
    """Also if crowded buckets and large components are cut into blocks."""
    rows = HARD + families(4)
    got = minhash.minhash_near_duplicates(table(spark, rows), **how)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(rows), key=repr)


def test_centre_is_like_nobody(spark, monkeypatch):
    """The least row of every bucket is unlike the others, which are alike: their link is found all the same."""
    rnd = random.Random(2)
    base = [word(rnd) for _ in range(60)]
    far = [(1, " ".join(base[:22] + [word(rnd) for _ in range(40)]))]
    rows = far + [(k, " ".join(base[:58] + [word(rnd), word(rnd)])) for k in (2, 3, 4)]
    monkeypatch.setattr(minhash, "bands_of", lambda bins: np.arange(minhash.BANDS))  # all rows share all buckets
    got = minhash.minhash_near_duplicates(table(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))
    assert sorted(r["component_id"] for r in got.collect()) == [1, 2, 2, 2]


def test_many_copies_and_no_rows(spark):
    rows = [(k, "the very same short text") for k in range(500)] + [(1000 + k, f"the very same short text {k} and then some") for k in range(3)]
    got = minhash.minhash_near_duplicates(table(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))
    assert minhash.minhash_near_duplicates(table(spark, [])).count() == 0
    assert minhash.minhash_near_duplicates(table(spark, HARD[:1])).collect()[0]["kept"]


def test_bins_agree_as_sets_do():
    """Over many pairs of small and larger sets the share of equal bins is the similarity."""
    rng = np.random.default_rng(1)
    for a, b, shared in ((4, 5, 4), (10, 10, 8), (300, 300, 260), (3, 3, 1)):
        agree = []
        for _ in range(300):
            both = rng.integers(0, 1 << 63, a + b - shared, dtype=np.uint64) * np.uint64(2)
            x, y = np.unique(both[:a]), np.unique(both[a - shared :])
            agree.append((minhash.bins_of(x) == minhash.bins_of(y)).mean())
        assert abs(np.mean(agree) - shared / (a + b - shared)) < 0.03
