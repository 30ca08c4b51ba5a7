"""Near duplicates by five-word shingles against all pairs compared exactly."""

import os
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from kelpline.llm import common, similar

DIR = "/root/testdata/sf0.01"


def word(rnd):
    return "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8)))


def shingled(text):
    ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else {()}


def components(rows, least=0.8):
    """Row numbers by component, from all pairs that share a shingle."""
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in holders[g]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if n >= least * (len(s) + len(sets[j]) - n) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def pairs_together(rows, got, want):
    """Of row pairs that belong together, chained by component, the share that is; and the wrongly joined components."""
    of = lambda r: got[r]
    members, right, total = {}, 0, 0
    for r, c in zip(rows, want, strict=True):
        members.setdefault(c, []).append(r)
    for m in members.values():
        for a, b in zip(m, m[1:]):
            total += 1
            right += of(a) == of(b)
    ids = {}
    for r, c in zip(rows, want, strict=True):
        ids.setdefault(got[r], set()).add(c)
    return right, total, sum(len(x) > 1 for x in ids.values())


def run(spark, table, **how):
    import hashlib

    df = spark.createDataFrame([(i, t, 0) for i, t in table], "doc_id long, text string, key int")
    found = {(r["doc_id"], r["text_md5"]): r for r in similar.similar_documents(df, **how).collect()}
    md5 = lambda t: None if t is None else hashlib.md5(t.encode()).hexdigest()
    assert len({k for k, r in found.items() if r["stays"]}) == sum(r["stays"] for r in found.values())
    return {(i, t): found[i, md5(t)]["component_id"] for i, t in table}, found


def edited(rnd, base, kind, n):
    copy = list(base)
    if kind == 0:
        for _ in range(n // 5):
            copy[rnd.randrange(len(copy))] = word(rnd)
    elif kind == 1:
        copy += [word(rnd) for _ in range(n)]
    else:
        copy[-n:] = [word(rnd) for _ in range(n)]
    return copy


HARD = [(None, None), (None, "no id here at all"), (1, ""), (1, ""), (2, None), (3, "   \n\t"), (4, "one"), (5, "two words"), (5, "Two  words"), (9, "tie"), (10, "tie"), (7, "word " * 9000)]


@pytest.mark.parametrize("how", [{}, {"rows": 6, "most": 2500}])
def test_against_all_pairs(spark, how):
    """Scattered, appended and replaced words, chains of small edits, short texts; also if buckets and components are cut into blocks."""
    rnd = random.Random(9)
    rows = list(HARD)
    for k in range(24):
        base = [word(rnd) for _ in range(rnd.choice([8, 12, 40, 300]))]
        rows.append((1000 * (k + 1), " ".join(base)))
        for j in range(1, 8):
            rows.append((1000 * (k + 1) + j, " ".join(edited(rnd, base, j % 3, max(1, rnd.randrange(0, max(2, len(base) // 4)))))))
        for j in range(8, 12):
            base = edited(rnd, base, 0, max(5, len(base) // 20))
            rows.append((1000 * (k + 1) + j, " ".join(base).upper() if j == 9 else "\n".join(base)))
    got, found = run(spark, rows, **how)
    want = components(rows)
    right, total, wrong = pairs_together(rows, got, want)
    assert right >= 0.99 * total and wrong == 0
    assert got[1, ""] == 1 and got[2, None] == 1 and got[5, "Two  words"] == 5 and got[10, "tie"] == 9 and got[None, None] == 1 and got[None, "no id here at all"] is None
    assert similar.similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_joined_sets():
    """Against all pairs, with groups, rows known to be joined and empty input."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 40, 120):
        group = np.sort(rng.integers(0, 4, n))
        sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint64)) for _ in range(n)]
        known = rng.random(n) < 0.1
        label = np.arange(n)

        def join(a, b):
            label[label == max(label[a], label[b])] = min(label[a], label[b])

        for a in range(n):
            for b in range(a):
                if group[a] == group[b]:
                    shared = len(np.intersect1d(sets[a], sets[b]))
                    if known[a] and known[b] or shared >= 0.6 * (len(sets[a]) + len(sets[b]) - shared):
                        join(a, b)
        assert similar.joined_sets(group, sets, known, 0.6).tolist() == label.tolist()


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_recall_on_tables(spark):
    docs = common.documents(spark, DIR).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got, _ = run(spark, rows)
    right, total, wrong = pairs_together(rows, got, components(rows))
    assert total > 50 and right >= 0.99 * total and wrong == 0


def test_stage_keeps_rows(spark):
    """One row of each group, also where doc_ids are repeated or null."""
    rnd = random.Random(3)
    a, b = (" ".join(word(rnd) for _ in range(100)) for _ in range(2))
    rows = [(1, a, "x"), (2, a + " more", "x"), (5, b, "x"), (5, a + " more", "x"), (5, b, "w"), (None, b + " too", "x"), (None, "alone with no number", "y"), (None, None, "x"), (None, None, "a"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(1, a, "x"), (5, b, "w"), (None, "alone with no number", "y"), (7, "", "x")], key=repr)
