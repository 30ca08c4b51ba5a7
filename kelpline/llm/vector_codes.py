"""Vectors as four codes of one byte each: product quantisation in whole numbers.

Vectors are turned once into blocks of columns: a row of the stored table holds some thousand vectors
as one NumPy array with a dimension per line. A round of learning is one ``treeAggregate`` over these
blocks: distances to all entries of a part's codebook accumulate dimension by dimension, ``np.add.at``
sums the components and counts of each entry's parts, and the tensors of tasks are merged by a tree
whose depth grows with the number of tasks, so the driver receives a few tensors of fixed size
(entries x dimensions), however many vectors there are. All numbers are integers, so neither the order
of rows nor the shape of the tree changes a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block; rows of a block whose distances are held at a time; tensors that one step of the tree merges.
BLOCK, AT_ONCE, MERGED = 4096, 512, 8
#: Greatest whole component: beyond it the errors of a vector might not fit 64 bits.
MOST = 1 << 26
_BLOCK = "ids binary, nulls binary, labels binary, unlabelled binary, dims int, block binary"


def whole_components(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector can be coded, with ``_whole``: its components times 1024, rounded down.
    Rows go whose vector is null or empty, holds a null, NaN or infinite component, has a length
    that four parts can't share, or another length than most of the rest (of equally frequent
    ones the longer counts). Components beyond ±65536 count as that."""
    x = F.col(vector)
    fine = vectors.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0)).filter(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    length = fine.groupBy(F.size(x).alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    fine = fine.filter(F.size(x) == (length["n"] if length else 0))
    return fine.withColumn("_whole", F.transform(x, lambda v: F.least(F.greatest(F.floor(v.cast("double") * SCALE), F.lit(-MOST)), F.lit(MOST)).cast("int")))


def blocks(whole: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of many vectors: keys and labels, and the components as a line of 32-bit numbers per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lines = np.ascontiguousarray(part.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(part.num_rows, -1).T)
                row = []
                for c in (part.column(0), part.column(1)):
                    row += [c.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.asarray(c.is_null().to_numpy(zero_copy_only=False), np.uint8).tobytes()]
                yield pa.RecordBatch.from_arrays([*(pa.array([b], pa.binary()) for b in row), pa.array([lines.shape[0]], pa.int32()), pa.array([lines.tobytes()], pa.binary())], names=["ids", "nulls", "labels", "unlabelled", "dims", "block"])

    return common.mapped(whole.select(F.col(key).cast("long").alias("ids"), F.col(label).cast("long").alias("labels"), "_whole"), run, _BLOCK)


def first_entries(whole: DataFrame, key: str) -> np.ndarray:
    """Codebooks (part, entry, position) of the 256 least keys, ascending; null keys are last, and of equal keys the least vectors come first."""
    rows = whole.select(key, "_whole").orderBy(F.col(key).asc_nulls_last(), "_whole").limit(ENTRIES).collect()
    if not rows:
        return np.zeros((PARTS, 0, 0), np.int64)
    return np.ascontiguousarray(np.array([r["_whole"] for r in rows], np.int64).reshape(len(rows), PARTS, -1).transpose(1, 0, 2))


def nearest(lines: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors in ``lines`` (position, vector) the nearest of ``entries`` (entry, position), of
    equally near ones the first, and its squared distance. Where the values allow it exactly, 32-bit
    numbers are used."""
    most = max(int(np.abs(lines).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.int32 if len(lines) * (2 * most) ** 2 < 1 << 31 else np.int64
    lines, entries = lines.astype(kind), np.ascontiguousarray(entries.T.astype(kind))
    n = lines.shape[1]
    found, far = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(0, n, AT_ONCE):
        here = lines[:, a : a + AT_ONCE]
        total = np.zeros((here.shape[1], entries.shape[1]), kind)
        gap = np.empty_like(total)
        for x, e in zip(here, entries, strict=True):
            np.subtract(x[:, None], e[None, :], out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
        found[a : a + AT_ONCE] = best = total.argmin(1)
        far[a : a + AT_ONCE] = total[np.arange(len(best)), best]
    return found, far


def _lines(dims: int, block: bytes) -> np.ndarray:
    return np.frombuffer(block, "<i4").reshape(dims, -1)


def _summed(codebooks: np.ndarray):
    """Of a block, added to the tensors so far: sums (part, entry, position) and counts (part, entry)."""
    parts, entries, width = codebooks.shape

    def add(so_far, row):
        sums, counts = so_far or (np.zeros((parts, width, entries), np.int64), np.zeros((parts, entries), np.int64))
        lines = _lines(row["dims"], bytes(row["block"]))
        for p in range(parts):
            own = lines[p * width : (p + 1) * width]
            found, _ = nearest(own, codebooks[p])
            np.add.at(counts[p], found, 1)
            for j in range(width):
                np.add.at(sums[p, j], found, own[j].astype(np.int64))
        return sums, counts

    return add


def _merged(a, b):
    return (a[0] + b[0], a[1] + b[1]) if a and b else a or b


def learn(coded: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after so many rounds over all blocks: each entry becomes the mean of its parts, rounded down; entries without parts stay."""
    rdd = coded.select("dims", "block").rdd
    depth = max(2, ceil(log(max(2, rdd.getNumPartitions()), MERGED)))
    for _ in range(rounds):
        sums, counts = rdd.treeAggregate(None, _summed(codebooks), _merged, depth)
        mean = np.floor_divide(sums.transpose(0, 2, 1), np.maximum(counts, 1)[:, :, None])
        codebooks = np.where(counts[:, :, None] > 0, mean, codebooks)
    return codebooks


def assigned(coded: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector in the blocks."""
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = _lines(row["dims"], row["block"])
                found, far = zip(*(nearest(lines[p * width : (p + 1) * width], codebooks[p]) for p in range(parts)), strict=True)
                text = np.stack(found, 1).astype(np.uint8).tobytes().hex()
                column = lambda v, n: pa.array(np.frombuffer(row[v], "<i8"), pa.int64(), mask=np.frombuffer(row[n], np.uint8).astype(bool))  # noqa: B023, E731
                codes = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([column("ids", "nulls"), column("labels", "unlabelled"), codes, pa.array(np.sum(far, 0), pa.int64())], names=["vec_id", "label", "code", "error"])

    return common.mapped(coded, run, "vec_id long, label long, code string, error long")


def vector_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of all vectors that can be coded (``whole_components``), and the codebooks.

    Each row is coded by itself, so repeated keys and equal vectors give as many rows; a null key or
    label stays null. With fewer than 256 vectors there are as many entries as vectors; without any
    the codebooks are empty and there are no rows. Other columns are not looked at."""
    spark = vectors.sparkSession
    common.tune(spark)
    named = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    whole = whole_components(named)
    codebooks = first_entries(whole, "vec_id")
    if not codebooks.size:
        return spark.createDataFrame([], "vec_id long, label long, code string, error long"), codebooks
    coded = common.stored(blocks(whole, "vec_id", "label"), "vectors")
    codebooks = learn(coded, codebooks)
    return assigned(coded, codebooks), codebooks


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as four codes, with their errors, the error summed over all rows of a label
    (nulls together), and a hash of the codebooks. Sums by label are aggregates joined back, so the
    rows of a common label need not meet."""
    rows, codebooks = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = common.stored(rows, "codes")
    totals = rows.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return rows.join(totals, F.col("label").eqNullSafe(F.col("_of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
