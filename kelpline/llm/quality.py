"""Quality by weak supervision: rules vote or abstain, expectation-maximisation finds how
far each rule can be trusted, and the posterior probability of good quality decides.

No label is used. The rules' votes on all documents are counted by vote pattern; there
are at most ``3 ** rules`` patterns, so the counts fit the driver at any size, and the
model is fitted on every document of the table. The same patterns, with their posteriors,
are then looked up for each document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import common

_WINDOW = 5
_SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
_UPPER, _LETTER = (bytes(c for c in range(256) if c not in keep) for keep in (range(65, 91), (*range(65, 91), *range(97, 123), *range(128, 256))))
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_kinds long, n_upper long, n_letters long, n_loud long, n_stops long"
#: Where EM starts, and what it is held to by the weight of a share of all documents: how often a rule that votes says "bad" of
#: good documents, of documents that are bad in the rule's own way, and of those bad in another way.
_OF_GOOD, _OF_OWN, _OF_OTHER, _WEIGHT = 0.005, 0.95, 0.02, 0.001
#: Rounds; least change of the prior; share of documents taken as good at first.
_ROUNDS, _CHANGE, _PRIOR = 200, 1e-9, 0.85


def repeat_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    windows = list(zip(*(words[i:] for i in range(window)), strict=False))
    counts = Counter(windows) if len(set(windows)) < len(windows) else {}
    total = end = 0
    if counts:
        for i, w in enumerate(windows):
            if counts[w] > 1:
                total += i + window - max(i, end)
                end = i + window
    return total


def features(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return (
        len(words), len(b"".join(words).decode("utf-8", "replace")), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), len(set(words)), len(text.translate(None, _UPPER)), len(text.translate(None, _LETTER)), text.count(b"!"), text.count(b".") + text.count(b"?"),
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        for batch in batches:
            counts = np.array([features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in counts.T)], names=names)

    return common.mapped(docs.select("doc_id", "text"), run, _SCHEMA)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, bad: float, good: float, when: Column | None = None) -> Column:
    """-1 (bad) from ``bad`` on, 1 (good) up to ``good``, 0 (abstains) between or where ``when`` fails."""
    vote = F.when(value >= bad, -1).when(value <= good, 1).otherwise(0)
    return vote if when is None else F.when(when, vote).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by rule. Short texts let most rules abstain: shares of few words say little."""
    long = F.col("n_words") >= 30
    mean = _share("word_chars", "n_words")
    return {
        "repeats": _vote(_share("n_repeat_words", "n_words"), 0.5, 0.05, long),
        "lines": _vote(_share("n_dup_lines", "n_lines"), 0.5, 0.0, F.col("n_lines") >= 4),
        "symbols": _vote(_share("n_symbols", "n_words"), 0.2, 0.02),
        "loud": _vote(_share("n_loud", "n_words"), 0.3, 0.05),
        "upper": _vote(_share("n_upper", "n_letters"), 0.3, 0.12, F.col("n_letters") >= 20),
        "variety": _vote(-F.log(F.greatest("n_kinds", F.lit(1))) / F.log(F.greatest("n_words", F.lit(2))), -0.72, -0.8, long),  # by logarithms, as a text's words repeat more the longer it is
        "stops": _vote(-_share("n_stops", "n_words"), -0.004, -0.02, long),
        "length": F.when((mean > 12) | (mean < 2.5), -1).when((mean >= 3.5) & (mean <= 8), 1).otherwise(0),
    }


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the hidden classes, and P(the rule says "bad" | class, it votes) by class and
    rule, by EM over distinct patterns. Class 0 is good; class r + 1 is bad in the way that
    rule r looks for, as documents are seldom bad in all ways. An abstention says nothing."""
    n_rules, mass = patterns.shape[1], counts.sum()
    start = np.full((n_rules + 1, n_rules), _OF_OTHER)
    start[0] = _OF_GOOD
    start[np.arange(n_rules) + 1, np.arange(n_rules)] = _OF_OWN
    share = np.array([_PRIOR, *[(1 - _PRIOR) / n_rules] * n_rules])
    says, held = start, _WEIGHT * mass / n_rules + 1
    bad, voted = (patterns == -1).astype(float), (patterns != 0).astype(float)
    for _ in range(_ROUNDS if len(counts) else 0):
        w = counts[:, None] * classes(patterns, share, says)
        before, share = share, (w.sum(0) + 1) / (mass + n_rules + 1)
        says = (w.T @ bad + held * start) / (w.T @ voted + held)
        if np.abs(share - before).max() < _CHANGE:
            break
    return share, says


def classes(patterns: np.ndarray, share: np.ndarray, says: np.ndarray) -> np.ndarray:
    """P(class | votes) by pattern."""
    odds = np.log(share) + (patterns == -1) @ np.log(says).T + (patterns == 1) @ np.log1p(-says).T
    odds -= odds.max(1, keepdims=True)
    p = np.exp(odds)
    return p / p.sum(1, keepdims=True)


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts, base_failed, the posterior ``quality`` and kept for every row.

    Null and empty texts have no words and fail the base rule. Repeated rows count and are
    judged each. An empty table gives no rows. Columns but doc_id and text are not looked
    at; doc_id may be null. A text's features are counted over all of it, in some times its own
    size."""
    spark = docs.sparkSession
    common.tune(spark)
    seen = common.stored(measured(docs), "quality")
    votes = rules()
    code = sum(((v + 1) * 3**i for i, v in enumerate(votes.values())), F.lit(0)).cast("int")
    coded = seen.withColumn("pattern", code)
    # at most 3 ** rules rows
    found = {r["pattern"]: r["n"] for r in coded.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    patterns = np.array([[c // 3**i % 3 - 1 for i in range(len(votes))] for c in found], np.int64).reshape(-1, len(votes))
    p = classes(patterns, *fit(patterns, np.array(list(found.values()), float)))[:, 0]
    table = spark.createDataFrame([(c, float(x)) for c, x in zip(found, p, strict=True)], "pattern int, quality double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return coded.join(F.broadcast(table), "pattern", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= least)).alias("kept"), "quality")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.documents(spark, sf_dir))
