"""Writers. With ``dry_run`` a step computes and reports, and writes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.operators.order import numbered


def append(df: DataFrame, path: str, dry_run: bool = False, partition_by: list[str] | None = None) -> None:
    if not dry_run:
        (df.write.mode("append").partitionBy(*partition_by) if partition_by else df.write.mode("append")).parquet(path)


def json_lines(df: DataFrame, path: str, dry_run: bool = False) -> None:
    if not dry_run:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def summary(df: DataFrame, path: str, dry_run: bool = False) -> dict:
    """Write and return a one-row summary. Only aggregates belong into it."""
    row = df.head()
    if not dry_run:
        df.coalesce(1).write.mode("overwrite").json(path)
    return row.asDict() if row else {}


def files(df: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Write each row's ``content`` (binary) as a file of its own at ``path`` under ``root``, by the tasks
    that hold the rows, and give path and bytes. A repeated task writes the same files again. The
    result is stored in the folder beside the files, so they are written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{top}/{path}") as out:
                    out.write(content or b"")
            size = [len(c or b"") for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64())], names=["path", "bytes"])

    rows = df.select("path", F.col("content").cast("binary").alias("content"))
    if dry_run:
        return rows.select("path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes"))
    written = rows.mapInArrow(run, "path string, bytes long")
    written.write.mode("overwrite").parquet(f"{root.rstrip('/')}_written")
    return df.sparkSession.read.parquet(f"{root.rstrip('/')}_written")


def label_files(df: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """(split, stem, text): a label file for each image, in a folder for each split; an image without
    objects has an empty file."""
    return files(df.select(F.concat_ws("/", "split", F.concat("stem", F.lit(".txt"))).alias("path"), F.coalesce("text", F.lit("")).alias("content")), path, dry_run)


def insert(df: DataFrame, path: str, by: str, dry_run: bool = False) -> DataFrame:
    """Append rows with ids counted on from the greatest stored one, in the order of ``by`` (distinct
    values), and give the rows with their ``id``."""
    spark = df.sparkSession
    try:
        last = spark.read.parquet(path).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        last = 0
    out = numbered(df, by, "id", last + 1)
    append(out, path, dry_run)
    return out


def provenance(new: DataFrame, path: str, dry_run: bool = False) -> None:
    append(new, path, dry_run)
