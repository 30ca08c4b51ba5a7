"""The highest-scoring documents of each question, by branch and bound over trees of greatest scores.

1. Documents become shards of postings, each one row of a stored table: of the terms that the
   questions name, which documents hold them and how often. Counts over all shards give the weights.
2. In a shard every term has a tree over ranges of documents: a leaf has the greatest score that the
   term adds to any document of its range, an inner node the greatest of its children.
3. A question descends best first: of all open nodes that of the highest bound, the sum of its terms'
   greatest scores, is opened next. Nodes whose bound is below the last place so far are never opened;
   those that equal it are, as a tie may be won by the smaller doc_id. A task carries the best of
   a question from shard to shard, so later shards open little.

The best of all tasks are merged in two steps. Questions are taken in blocks of a bounded number of
terms; what the driver and a task hold of them is one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm import common

TOP = 50
#: Documents of a leaf at least, children of a node, numbers that a level of a shard's trees may have, pairs of item and term in a block of questions.
LEAF, FAN, CELLS, PAIRS = 32, 8, 1 << 22, 1 << 18
#: Rows of the first merging step: what tasks found is dealt to so many groups.
GROUPS = 64
_NULL = 1 << 63  # the place of a null doc_id in the order, after all others
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_SHARD = "docs long, terms long, ids binary, nulls binary, lengths binary, counts binary, term binary, tf binary"


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split() if text else []


@dataclass
class Questions:
    """A block of questions: number of each term, and of each item the numbers of its terms."""

    number: dict[bytes, int]
    items: dict[int | None, np.ndarray]


def question_blocks(items: DataFrame, most: int = PAIRS) -> Iterator[Questions]:
    """Items (item_id, text) in blocks of about ``most`` pairs of item and term. Rows of one item_id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = sorted(set(terms(t)))
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "term"])

    pairs = common.stored(common.mapped(items.select(F.col("item_id").cast("long"), "text"), run, "item_id long, term binary").distinct(), "questions")
    n = -(-pairs.count() // most)
    for k in range(n):
        found: dict[int | None, list[int]] = {}
        number: dict[bytes, int] = {}
        for r in pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect():
            found.setdefault(r["item_id"], []).append(number.setdefault(bytes(r["term"]), len(number)))
        if found:
            yield Questions(number, {i: np.array(sorted(t), np.int64) for i, t in found.items()})


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """A row per shard: how many documents have terms and how many terms there are, and of each
    document with a term of the questions its id, length, and terms with their counts."""
    held, width = docs.sparkSession.sparkContext.broadcast(number), max(1, len(number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for batch in batches:
            lengths, pairs = np.zeros(batch.num_rows, np.int64), []
            for d, t in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                every = terms(t)
                lengths[d] = len(every)
                known = np.array([x for x in map(get, every) if x is not None], np.int64)
                pairs.append(known + d * width)
            pair, tf = np.unique(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), return_counts=True)
            counts = np.bincount(pair // width, minlength=batch.num_rows)
            has = counts > 0
            ids = batch.column(0)
            null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8)[has]
            value = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")[has]
            row = [value, null, lengths[has].astype("<i8"), counts[has].astype("<i8"), (pair % width).astype("<i4"), tf.astype("<i4")]
            yield pa.RecordBatch.from_arrays([pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in row)], names=["docs", "terms", "ids", "nulls", "lengths", "counts", "term", "tf"])

    return common.mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, _SHARD)


def weights(shards: DataFrame, width: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term of the questions, the number of documents with terms, and of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width, np.int64)
        for batch in batches:
            for term in batch.column("term").to_pylist():
                held += np.bincount(np.frombuffer(term, "<i4"), minlength=width)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(held[there], pa.int64())], names=["term", "df"])

    total = shards.agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first()
    n, length = total["n"] or 0, total["l"] or 0
    out = np.zeros(width, np.int64)
    for r in common.mapped(shards.select("term"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = floor(1000 * log((2 * n + 2) / (2 * r["df"] + 1)))
    return out, n, length


def added(tf: np.ndarray, weight: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """What each posting adds to its document's score."""
    if 50 * n * int(lengths.max(initial=0)) < 1 << 63:
        m = 50 + 50 * lengths * n // max(1, total)
    else:
        m = np.array([50 + 50 * x * n // total for x in lengths.tolist()], np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class MaxTrees:
    """Of a shard's documents (postings document by document: term, score), a tree per term over ranges of documents."""

    def __init__(self, starts: np.ndarray, term: np.ndarray, score: np.ndarray, leaf: int = LEAF, fan: int = FAN, cells: int = CELLS):
        self.starts, self.term, self.score, self.fan = starts, term, score, fan
        n = len(starts) - 1
        self.rows, row = np.unique(term, return_inverse=True)
        self.leaf = max(leaf, -(-n * len(self.rows) // cells))  # many terms: fewer, wider leaves
        level = np.zeros((len(self.rows), max(1, -(-n // self.leaf))), np.int64)
        doc = np.repeat(np.arange(n), np.diff(starts))
        np.maximum.at(level, (row, doc // self.leaf), score)
        self.levels = [level]
        while level.shape[1] > 1:
            level = np.maximum.reduceat(level, np.arange(0, level.shape[1], fan), axis=1)
            self.levels.append(level)

    def best(self, wanted: np.ndarray, asked: np.ndarray, order: list[int], heap: list[tuple[int, int]], most: int) -> int:
        """Push the documents that belong to the ``most`` best for the terms ``wanted`` onto ``heap``, as
        (score, minus the place in ``order``), worst first. ``asked`` marks the terms. How many
        leaves were opened."""
        rows = np.searchsorted(self.rows, wanted)
        rows = rows[rows < len(self.rows)]
        rows = rows[np.isin(self.rows[rows], wanted)]
        if not len(rows):
            return 0
        top, opened = len(self.levels) - 1, 0
        nodes = [(-int(self.levels[top][rows, 0].sum()), top, 0)]
        while nodes:
            bound, level, node = heapq.heappop(nodes)
            least = heap[0][0] if len(heap) == most else 1
            if -bound < least:
                break
            if level:
                a = node * self.fan
                below = self.levels[level - 1][rows, a : a + self.fan].sum(0)
                for i, b in enumerate(below.tolist()):
                    if b >= least:
                        heapq.heappush(nodes, (-b, level - 1, a + i))
                continue
            opened += 1
            ends = self.starts[node * self.leaf : (node + 1) * self.leaf + 1]
            here = slice(int(ends[0]), int(ends[-1]))
            sums = np.concatenate([[0], np.cumsum(np.where(asked[self.term[here]], self.score[here], 0))])
            got = np.diff(sums[ends - ends[0]])
            for i in np.flatnonzero(got >= least).tolist():
                one = (int(got[i]), -order[node * self.leaf + i])
                if len(heap) < most:
                    heapq.heappush(heap, one)
                elif one > heap[0]:
                    heapq.heapreplace(heap, one)
        return opened


def _found(shards: DataFrame, questions: Questions, weight: np.ndarray, n: int, total: int, most: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each question in what one task reads."""
    held = shards.sparkSession.sparkContext.broadcast((questions.items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = held.value
        best: dict[int | None, list[tuple[int, int]]] = {i: [] for i in items}
        asked = np.zeros(len(weight), bool)
        for batch in batches:
            for row in batch.to_pylist():
                value = lambda c, kind="<i8": np.frombuffer(row[c], kind).astype(np.int64)  # noqa: B023, E731
                term, tf, counts = value("term", "<i4"), value("tf", "<i4"), value("counts")
                if not len(term):
                    continue
                score = added(tf, weight[term], np.repeat(value("lengths"), counts), n, total)
                trees = MaxTrees(np.concatenate([[0], np.cumsum(counts)]), term, score)
                order = [_NULL if null else i for i, null in zip(value("ids").tolist(), row["nulls"], strict=True)]
                for i, wanted in items.items():
                    asked[wanted] = True
                    trees.best(wanted, asked, order, best[i], most)
                    asked[wanted] = False
        flat = [(i, None if -d == _NULL else -d, s) for i, heap in best.items() for s, d in heap]
        columns = list(zip(*flat, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return common.mapped(shards.drop("docs", "terms"), run, "item_id long, doc_id long, score long")


def _ranked(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def ranked_search(docs: DataFrame, items: DataFrame, most: int = TOP, pairs: int = PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the ``most`` documents of the highest score above 0,
    equal scores by ascending doc_id, a null doc_id last.

    Null and empty texts have no terms: such documents are never found, such items find nothing.
    Rows that repeat a doc_id are ranked each; rows of one item_id, null too, are one item with
    the terms of all. A long text is one document like others. Empty tables give no rows, and
    columns other than doc_id, text and item_id, text are not looked at. ``pairs`` bounds what
    is held of the items at a time; the documents are read once for each such block."""
    spark = docs.sparkSession
    common.tune(spark)
    out = spark.createDataFrame([], "item_id long, doc_id long, score long, rank int")
    for block in question_blocks(items, pairs):
        shards = common.stored(postings(docs, block.number), "postings")
        weight, n, total = weights(shards, len(block.number))
        found = _found(shards, block, weight, n, total, most).withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        near = _ranked(found, ["item_id", "_group"], most).drop("rank", "_group")
        out = out.unionByName(_ranked(near, ["item_id"], most))
    return out.select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
