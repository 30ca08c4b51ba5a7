"""Packing of documents into fixed-size training sequences (exact-complement hashing).

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the
driver. There the plan is made: for each length, longest first, the gap that it
leaves is looked up in an index of the single, pair and triple sums of the lengths still
available, and the combination is consumed as often as the counts allow; what has
no exact complement goes by best fit. Pairs are listed by their sum; a triple is a length and
a listed pair, as the sums of three of 2048 lengths have over a thousand million
combinations. The plan says, for each run of ranks within a
length, which sequences take those pieces and at which offset. Pieces get their rank
within their length without meeting in one task: counts by (length, bucket), then
ranks inside a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kelpline.llm import common, tokens

CAPACITY, END_ID = 2048, 0
#: Documents for a bucket, in which pieces of one length are ranked by one task: also a length that most pieces have is in many buckets.
PER_BUCKET = 20_000
_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("bucket", T.IntegerType())])


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, buckets: int) -> DataFrame:
    """Pieces of the encoded documents: doc_id, piece, start, length, ids_crc32, and the
    bucket that ranks them. ``docs`` has doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for a, b in common.slices([len(t or b"") for t in texts], 4 << 20):
                ids, counts = enc.encode(texts[a:b])
                ids, out, at = ids.astype("<u4", copy=False), [], 0
                for doc_id, n in zip(doc_ids[a:b], counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4", copy=False)
                    at += n
                    for piece, s in enumerate(range(0, n + 1, capacity)):
                        part = own[s : s + capacity]
                        crc = zlib.crc32(part)
                        out.append((doc_id, piece, s, len(part), crc, zlib.crc32(b"%d %d" % (doc_id or 0, piece), crc) % buckets))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=_PIECES.names)
        enc.forget()

    return common.mapped(docs.select("doc_id", "text"), run, _PIECES)


def pairs_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pairs of ``lengths`` (in order) whose sum is below ``capacity``, by sum, of one sum the least alike pair
    first. Only such pairs are made, as narrow numbers: the driver holds them beside all else."""
    lengths = lengths.astype(np.int16 if capacity < 1 << 15 else np.int32)
    others = np.searchsorted(lengths, np.minimum(lengths, capacity - 1 - lengths), "right")
    a, b = np.repeat(lengths, others), np.concatenate([lengths[:0], *(lengths[:n] for n in others)])
    return np.stack([a, b], 1)[np.lexsort((-a, a + b))]


class Sums:
    """Sums of one, two and three lengths, and the combinations that make each, under counts of what
    is still there. A combination that has run out is never looked at again: counts only fall."""

    def __init__(self, counts: dict[int, int], capacity: int, pairs: np.ndarray | None = None):
        self.have = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            self.have[n] = c
        self.pairs = pairs_of(np.flatnonzero(self.have), capacity) if pairs is None else pairs
        self.at = np.searchsorted(self.pairs.sum(1, dtype=np.int32), np.arange(capacity + 2))  # by sum the first pair that may be left
        self.end = self.at[1:].copy()
        self.third = np.minimum(np.arange(capacity + 1), capacity)  # by sum the greatest third length that may be left

    def there(self, combination: tuple[int, ...]) -> bool:
        return all(self.have[x] >= combination.count(x) for x in combination)

    def one(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.have[total] else None

    def two(self, total: int, besides: tuple[int, ...] = ()) -> tuple[int, ...] | None:
        """The first pair of the sum that is there, also together with some other lengths."""
        k = self.at[total]
        while k < self.end[total]:
            pair = tuple(self.pairs[k].tolist())
            if self.there((*pair, *besides)):
                return pair
            if k == self.at[total] and not self.there(pair):
                self.at[total] += 1
            k += 1
        return None

    def three(self, total: int, besides: tuple[int, ...]) -> tuple[int, ...] | None:
        """A length and a pair for what it leaves, the greatest length first."""
        c = int(self.third[total])
        while c > 0:
            if c < total - 1 and self.have[c]:
                pair = self.two(total - c, (*besides, c)) if self.have[c] > besides.count(c) else None
                if pair:
                    return (c, *pair)
            elif c == self.third[total]:
                self.third[total] -= 1
            c -= 1
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences follow each: of the plans whose complements
    have up to three, two, one and no lengths the one of the fewest sequences. Exact complements use
    up short lengths that best fit would need later, so where sums are scarce fewer of them are
    better; the last of the plans is best fit alone, so no plan is worse than that. The plans share
    one list of pairs."""
    pairs = pairs_of(np.array(sorted(n for n, c in counts.items() if c), np.int64), capacity)
    return min((_plan(counts, capacity, most, pairs) for most in (3, 2, 1, 0)), key=lambda p: sum(m for _, m in p))


def _plan(counts: dict[int, int], capacity: int, most: int, pairs: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """For each length, longest first, the gap that it leaves is looked up among the sums of one to
    ``most`` lengths that are left, and a combination is consumed as often as the counts allow;
    what has no exact complement goes by best fit, longest first."""
    sums = Sums(counts, capacity, pairs)
    have = sums.have
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        lengths, times = np.unique(pattern, return_counts=True)
        m = int((have[lengths] // times).min())
        have[lengths] -= m * times
        out.append((pattern, m))

    rest: list[tuple[int, int]] = []
    for length in range(capacity, 0, -1):
        gap = capacity - length
        while have[length] and not gap:
            take((length,))
        for found in (lambda: sums.one(gap), lambda: sums.two(gap, (length,)), lambda: sums.three(gap, (length,)))[:most]:
            while have[length] and gap and (others := found()) and sums.there((length, *others)):
                take((length, *others))
        if have[length]:
            rest.append((length, int(have[length])))
            have[length] = 0
    # best fit: open[g] holds the patterns that still have room for g
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, n in rest:
        for gap in sorted(g for g in open_ if g >= length):
            while n and open_.get(gap):
                pattern, m = open_[gap].pop()
                each = min(gap // length, max(1, n // m))
                used = min(m, n // each)
                if used < m:
                    open_[gap].append((pattern, m - used))
                open_.setdefault(gap - each * length, []).append(((*pattern, *[length] * each), used))
                n -= used * each
            if not open_.get(gap):
                open_.pop(gap, None)
        each = capacity // length
        if full := n // each:
            open_.setdefault(capacity - each * length, []).append(((length,) * each, full))
        if left := n % each:
            open_.setdefault(capacity - left * length, []).append(((length,) * left, 1))
    return out + [x for patterns in open_.values() for x in patterns]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, last rank + 1, first sequence, offset), by length and rank."""
    rows, ranks, base = [], {}, 0
    for pattern, m in patterns:
        offset = 0
        for length in pattern:
            r = ranks.get(length, 0)
            rows.append((length, r, r + m, base, offset))
            ranks[length], offset = r + m, offset + length
        base += m
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack the documents (doc_id, text) into sequences of at most ``capacity`` tokens.

    A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are one piece that holds the end id alone. Repeated rows and
    repeated or null doc_ids are packed as often as they occur. An empty table gives no
    rows. Other columns of ``docs`` are not looked at."""
    spark = docs.sparkSession
    common.tune(spark)
    buckets = max(64, common.width(spark), docs.select("doc_id").count() // PER_BUCKET)
    pieces = common.stored(cut_pieces(docs, tokenizer or tokens.default_tokenizer(), capacity, end_id, buckets), "pieces")
    # at most `capacity` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    common.give_back()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(in_bucket)).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(length) else table[:0]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECES.names[:5]), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*_PIECES.names[:5], "sequence_id", "offset"])

    schema = T.StructType([*_PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return common.mapped(ranked.select(*_PIECES.names[:5], "rank"), place, schema)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(common.documents(spark, sf_dir))
