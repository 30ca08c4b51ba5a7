"""Ranked search against scores of all documents."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from kelpline.llm import ranked_search
from kelpline.llm.ranked_search import MaxTrees

SCHEMA = "doc_id long, text string, rank string, score string, term string, ids string"
HARD = [(None, None), (None, "alpha beta no id"), (1, ""), (1, ""), (2, None), (3, " .,- \n"), (4, "Alpha"), (5, "alpha beta"), (5, "alpha beta"), (6, "ALPHA-beta"), (7, "gamma " * 9000), (8, "é😀 ñandú ÀB x1y")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def plain(docs, items, most=50):
    every = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in every), sum(sum(c.values()) for _, c in every)
    df = Counter(t for _, c in every for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in every:
            m = 50 + (50 * sum(c.values()) * n) // length if length else 0
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if score:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:most])]
    return out


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)]
    return [(10 + k - k % 7 // 6, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 60)))) for k in range(n)]


@pytest.mark.parametrize("most, pairs", [(50, 1 << 18), (3, 25)])
def test_against_all_scores(spark, monkeypatch, most, pairs):
    """Ties, repeated ids, null items; also with small leaves and questions in several blocks."""
    monkeypatch.setattr(ranked_search, "LEAF", 4)
    docs = HARD + corpus(3)
    items = [(1, "alpha beta"), (1, "gamma"), (2, "ñandú àb É😀"), (3, None), (4, "..."), (None, "Alpha w1"), (5, "nowhere else"), (6, "")] + [(20 + k, t) for k, (_, t) in enumerate(corpus(5, 12))]
    got = ranked_search.ranked_search(table(spark, docs).repartition(5), table(spark, items).withColumnRenamed("doc_id", "item_id"), most, pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(docs, items, most), key=repr)


def test_no_rows(spark):
    docs, items = table(spark, HARD), table(spark, [(1, "alpha")]).withColumnRenamed("doc_id", "item_id")
    assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("leaf, fan, cells", [(1, 2, 1 << 20), (8, 3, 1 << 20), (8, 8, 40)])
def test_trees(leaf, fan, cells):
    """The best of a shard by branch and bound are those of all scores, ties at the last place included, and most leaves stay closed."""
    rng = np.random.default_rng(leaf)
    n, width = 900, 30
    counts = rng.integers(0, 9, n)
    term = np.concatenate([np.sort(rng.choice(width, c, replace=False)) for c in counts])
    score = np.where(rng.random(len(term)) < 0.01, 1000, rng.integers(1, 4, len(term)))
    starts = np.concatenate([[0], np.cumsum(counts)])
    trees = MaxTrees(starts, term, score, leaf, fan, cells)
    closed = 0
    for k in range(40):
        wanted = np.sort(rng.choice(width + 5, 1 + k % 4, replace=False))
        asked = np.zeros(width + 5, bool)
        asked[wanted] = True
        full = [(int(score[a:b][asked[term[a:b]]].sum()), -d) for d, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]
        heap = []
        opened = trees.best(wanted, asked, list(range(n)), heap, 10)
        assert sorted(heap) == sorted(x for x in sorted(full, reverse=True)[:10] if x[0] > 0)
        closed += opened < trees.levels[0].shape[1] / 2
    assert cells == 40 or closed > 20
