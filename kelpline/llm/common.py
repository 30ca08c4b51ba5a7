"""What several corpus operators share: input, scratch storage, partitions."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.sources.scratch import scratch_path, scratch_root, stored

__all__ = ["as_row", "documents", "filesystem", "from_row", "give_back", "mapped", "ranges", "scratch_path", "scratch_root", "slices", "stored", "tune", "unused", "width"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(5 << 20))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow, after which the Python worker gives back what it doesn't need: workers
    live on from stage to stage."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def filesystem(path: str):
    """Of a path in a store that ``pyarrow.fs`` opens: the store, and the path in it. Tasks read and write files through it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def unused(columns: list[str], name: str) -> str:
    """The name, or a longer one that no column has in any case of letters."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def as_row(docs: DataFrame) -> DataFrame:
    """All columns as one, ``_row``: working columns beside it clash with none."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def from_row(columns: list[str], **other: Column) -> list[Column]:
    """The columns out of ``_row``, some of them replaced."""
    return [(other[c] if c in other else F.col("_row").getField(c)).alias(c) for c in columns]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..l-1 for each l in turn, in one array."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into runs of about ``most`` bytes; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
