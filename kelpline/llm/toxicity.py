"""Toxicity by a lexicon matched with Levenshtein automata, weighed by context.

The lexicon is learned from labelled documents: words, and beginnings of words, that toxic
documents hold in many different contexts and others hardly hold. Its terms form a trie.
The automaton of all strings within a term's allowed edits is run over that trie's nodes;
its states are made on demand and kept, so a word costs a step for each of its characters.
Terms that are hit are looked at in a window of words: quotation marks and words of
reporting speak for quoting, second persons for abuse. A logistic model over the summed
hits gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import common

#: A hundredth of the toxic documents hold a term, and no fewer than the first of these; it stands in them after and before so many
#: different words (of neighbours there are only so many, so that number ends at the second), and in so much greater a share of them
#: than of others; longest beginning of a word. All such terms are taken.
CONTEXTS, MOST_CONTEXTS, RATIO, LONGEST = 8, 20, 10.0, 10
#: Edits that a term of so many characters may have; words on each side that count as context.
EDITS, AROUND = ((9, 2), (5, 1), (0, 0)), 5
#: What a misspelled hit counts beside an exact one. Terms that so great a share of other documents come near to match exactly only.
MISSPELLED, NEAR_MISSES = 0.6, 0.002
_CACHE = 400_000

# Words that report what others say, and second persons, in the languages of the corpus.
_REPORTS = frozenset("said says wrote writes called calls quote quoted word term sagte sagt schrieb nannte wort dit disait écrit appelé mot dijo dice escribió llamó palabra".split())
_PERSONS = frozenset("you your yours you're u du dein deine ihr euch euer tu ton ta tes vous votre toi tú tus usted ustedes te".split())
_QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "”": "”", "»": "«"}

_TABLE = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).split() if text else []


class Lexicon:
    """Trie of terms and its Levenshtein automaton. A term ending in ``*`` is the beginning of words."""

    def __init__(self, terms: dict[str, float], exact: frozenset[str] = frozenset()):
        self.weights = terms
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, int, bool] | None] = [None]
        self.allowed: list[int] = [0]
        for term in sorted(terms):
            stem, open_ = term.rstrip("*"), term.endswith("*")
            edits, path, node = 0 if term in exact else next(k for least, k in EDITS if len(stem) >= least), [0], 0
            for c in stem:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.allowed.append(0)
                node = self.next[node][c]
                path.append(node)
            for x in path:
                self.allowed[x] = max(self.allowed[x], edits)
            if not self.ends[node] or open_:
                self.ends[node] = (term, edits, open_)
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []  # if the word ends here
        self.taken: list[tuple[str, int] | None] = []  # whatever follows
        self.members: list[frozenset] = []
        self.start = self._state({(0, 0)})
        self.hits: dict[bytes, bool] = {}

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """Pairs of a node and the edits so far, closed under skipping a term's characters."""
        best: dict[int, int] = {}
        work = sorted(pairs, key=lambda x: x[1])
        while work:
            node, k = work.pop()
            if k > self.allowed[node] or best.get(node, 99) <= k:
                continue
            best[node] = k
            work += [(child, k + 1) for child in self.next[node].values()]
        key = frozenset(best.items())
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.moves.append({})
            self.members.append(key)
            ends = [(k, self.ends[n]) for n, k in best.items() if self.ends[n] and k <= self.ends[n][1]]
            pick = lambda found: min(((k, t[0]) for k, t in found), default=None)
            whole, begun = pick(ends), pick([x for x in ends if x[1][2]])
            self.found.append(whole and (whole[1], whole[0]))
            self.taken.append(begun and (begun[1], begun[0]))
        return self.states[key]

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, with the number of edits."""
        state, begun = self.start, None
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                pairs = set()
                for node, k in self.members[state]:
                    pairs.add((node, k + 1))
                    for d, child in self.next[node].items():
                        pairs.add((child, k + (d != c)))
                to = self.moves[state][c] = self._state(pairs)
            state = to
            if (t := self.taken[state]) and (begun is None or t[1] < begun[1]):
                begun = t
            if not self.members[state]:
                return begun
        end = self.found[state]
        return min((x for x in (begun, end) if x), key=lambda x: x[1], default=None)

    def hit(self, text: str | None) -> bool:
        found = False
        for w in words(text):
            hit = self.hits.get(w)
            if hit is None:
                if len(self.hits) > _CACHE:
                    self.hits.clear()
                hit = self.hits[w] = self.match(w.decode("utf-8", "replace")) is not None
            found |= hit
        return found


def _parts(word: str) -> tuple[str, ...]:
    """A word and its beginnings."""
    return (word, *(word[:n] + "*" for n in range(3, min(len(word), LONGEST) + 1)))


def _documents_with(texts: DataFrame, terms_of: Callable[[], Callable[[str], Iterable[str]]]) -> DataFrame:
    """term and n: how many of ``texts`` (text) hold a word for which ``terms_of()`` gives the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known, n = terms_of(), {}, Counter()
        counts = lambda: pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["term", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms: set[str] = set()
                for w in set(words(text)):
                    found = known.get(w)
                    if found is None:
                        if len(known) > _CACHE:
                            known.clear()
                        found = known[w] = tuple(find(w.decode("utf-8", "replace")))
                    terms.update(found)
                n.update(terms)
                if len(n) > _CACHE:
                    yield counts()
                    n.clear()
        yield counts()

    return common.mapped(texts.select("text"), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _neighbours(texts: DataFrame, terms: frozenset[str]) -> DataFrame:
    """term and n: the lesser number of different words right before and right after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bool, str]] = set()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))], names=["term", "after", "word"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ws = [w.decode("utf-8", "replace") for w in words(text)]
                for i, w in enumerate(ws):
                    for p in _parts(w):
                        if p in terms:
                            seen.add((p, False, ws[i - 1] if i else ""))
                            seen.add((p, True, ws[i + 1] if i + 1 < len(ws) else ""))
                if len(seen) > _CACHE:
                    yield rows()
                    seen.clear()
        yield rows()

    pairs = common.mapped(texts.select("text"), run, "term string, after boolean, word string").distinct()
    return pairs.groupBy("term", "after").agg(F.count("*").alias("n")).groupBy("term").agg(F.min("n").alias("n"))


def _gathered(counts: DataFrame) -> dict[str, int]:
    return {r["term"]: r["n"] for r in counts.collect()}


def learn_terms(rows: DataFrame, n: tuple[int, int]) -> dict[str, float]:
    """Terms with their log odds from all ``rows`` (text, toxic), of which ``n`` are not toxic and toxic.

    The driver gets counts of terms that a hundredth of the toxic documents hold, at most a
    hundred times as many as one of these has words and beginnings of words on average."""
    toxic, others = (rows.filter(F.col("toxic") == c) for c in (1, 0))
    least = max(CONTEXTS, n[1] // 100)
    held = _gathered(_documents_with(toxic, lambda: _parts).filter(F.col("n") >= least))
    often = frozenset(held)
    beside = _gathered(_documents_with(others, lambda: lambda w: [p for p in _parts(w) if p in often]))
    docs = ({p: beside.get(p, 0) for p in held}, held)
    odds = lambda p: math.log((docs[1][p] + 0.5) / max(1, n[1])) - math.log((docs[0][p] + 0.5) / max(1, n[0]))
    often = frozenset(p for p in often if odds(p) >= math.log(RATIO))
    # copies of a text repeat the words around a term; a term of abuse turns up anywhere
    around = _gathered(_neighbours(toxic, often)) if often else {}
    good = {p: odds(p) for p, k in around.items() if k >= min(least, MOST_CONTEXTS)}
    chosen: dict[str, float] = {}
    for p in sorted(good, key=lambda p: (len(p.rstrip("*")), p)):
        stem = p.rstrip("*")
        if any(stem[:n] + "*" in chosen for n in range(3, len(stem) + 1)):
            continue  # an earlier beginning takes it in
        if p.endswith("*"):
            # down to the most specific form, while few toxic documents are lost, or some for getting rid of others
            while True:
                forms = [q for q in good if (q == stem or q.endswith("*") and len(q) == len(stem) + 2) and q.startswith(stem)]
                best = max(forms, key=lambda q: (docs[1][q], -docs[0][q]), default=None)
                kept = docs[1][best] / docs[1][stem + "*"] if best else 0
                if kept < (0.8 if best and docs[0][best] < docs[0][stem + "*"] else 0.98):
                    p = stem + "*"
                    break
                if best == stem:
                    p = stem
                    break
                stem = best.rstrip("*")
        chosen[p] = good[p]
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0])))


def evidence(text: str, lexicon: Lexicon) -> np.ndarray:
    """Of a text with hits: the weight of hits in abuse, of hits in quotation, and second persons near them."""
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text.lower())]
    quoted = np.zeros(len(text) + 2, bool)
    open_ = -1
    for i, c in enumerate(text):  # closed quotations on one line
        if c == "\n":
            open_ = -1
        elif open_ >= 0 and c == _QUOTES[text[open_]]:
            quoted[open_:i] = True
            open_ = -1
        elif open_ < 0 and c in _QUOTES:
            open_ = i
    out = np.zeros(3)
    for i, (w, start, _) in enumerate(tokens):
        hit = lexicon.match(w)
        if hit:
            near = {x[0] for x in tokens[max(0, i - AROUND) : i + AROUND + 1]}
            quoting = bool(quoted[min(start, len(text))]) or not near.isdisjoint(_REPORTS)
            out[int(quoting)] += lexicon.weights[hit[0]] * (MISSPELLED if hit[1] else 1)
            out[2] += not near.isdisjoint(_PERSONS)
    return np.log1p(out)


class Scorer:
    """Lexicon and logistic weights."""

    def __init__(self, terms: dict[str, float], exact: frozenset[str], weights: np.ndarray):
        self.terms, self.exact, self.weights = terms, exact, weights

    @classmethod
    def fit(cls, rows: DataFrame) -> "Scorer":
        """From all ``rows`` (text, toxic), of which each weighs the same."""
        counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        n = (counts.get(0, 0), counts.get(1, 0))
        # where the data say nothing, a quoted hit counts a fifth
        start = np.array([-4.0, 3.0, 0.6, 0.5])
        terms = learn_terms(rows, n) if n[1] else {}
        if not all(n):
            return cls(terms, frozenset(), start)

        def missed() -> Callable[[str], list[str]]:
            lexicon = Lexicon(terms)
            return lambda w: [m[0] for m in [lexicon.match(w)] if m and m[1]]

        near = _gathered(_documents_with(rows.filter("toxic = 0"), missed)) if terms else {}
        exact = frozenset(t for t, k in near.items() if k > max(1, NEAR_MISSES * n[0]))
        x = common.stored(_evidence(rows, terms, exact), "evidence")
        w, hold = start.copy(), np.array([0.5, 0.5, 2.0, 2.0])
        for _ in range(100):  # Newton's method, held to the start
            gradient, curve = _slopes(x, w)
            step = np.linalg.solve(curve + np.diag(hold), gradient - hold * (w - start))
            w = w + step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-6:  # so the error is about its square
                break
        return cls(terms, exact, w.round(9))  # sums of tasks come in any order

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + self.weights[1:] @ found)))))


def _evidence(rows: DataFrame, terms: dict[str, float], exact: frozenset[str]) -> DataFrame:
    """toxic, x (the evidence) and n: how many of ``rows`` (text, toxic) have these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, none = Lexicon(terms, exact), (0.0, 0.0, 0.0)
        for batch in batches:
            n: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                n[toxic, tuple(evidence(text, lexicon).tolist()) if lexicon.hit(text) else none] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.list_(pa.float64())), pa.array(n.values(), pa.int64())], names=["toxic", "x", "n"])

    return common.mapped(rows.select("text", "toxic"), run, "toxic int, x array<double>, n long").groupBy("toxic", "x").agg(F.sum("n").alias("n"))


def _slopes(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-likelihood of ``rows`` (toxic, x, n) under the weights: its gradient and its negative
    second derivatives."""
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + size * size)
        for batch in batches:
            y, n = (batch.column(c).to_numpy() for c in ("toxic", "n"))
            x = np.insert(batch.column("x").flatten().to_numpy().reshape(-1, size - 1), 0, 1.0, axis=1)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            total += np.concatenate([x.T @ (n * (y - p)), ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

    sums = np.zeros(size + size * size)
    for r in common.mapped(rows, run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    return sums[:size], sums[size:].reshape(size, size)


def training(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """text and toxic of all labelled documents; one with several labels is toxic if one says so,
    and of one with several texts the least counts."""
    marks = labels.filter(train & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.filter(train).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(marks, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """From every labelled document that isn't held out. Their texts are stored, as they are read five times."""
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    return Scorer.fit(common.stored(training(docs, labels, train), "labelled"))


def scored(docs: DataFrame, scorer: Scorer, column: str = "toxicity") -> DataFrame:
    """``docs`` with a column for the score of its text."""
    kept = [c for c in docs.columns if c != column]
    schema = docs.select(*kept).schema.add(column, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, none = Lexicon(scorer.terms, scorer.exact), scorer.score(np.zeros(3))
        for batch in batches:
            out = [scorer.score(evidence(text, lexicon)) if lexicon.hit(text) else none for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.float64())], names=schema.names)

    return common.mapped(docs.select(*kept), run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    Learned from all ``labels`` (doc_id, toxic) of documents whose crc32 of doc_id as text, modulo
    5, isn't 0; other label values than 0 and 1 are left out. Null, empty and wordless texts
    have the score of a text without hits. With no labels, or those of one class only, the
    lexicon is empty. A null doc_id is not held out. Repeated rows are scored each; an empty
    table gives no rows; other columns are not looked at. A text is worked on whole, in some
    times its own size."""
    common.tune(docs.sparkSession)
    out = scored(docs.select("doc_id", "text"), learn(docs, labels), "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
