"""Tables in folders by a hash of the key, of which a write touches only the folders of its keys.

A folder's rows are written again whole, by a table that dynamic partition overwrite swaps in at the end
of the job; a write that fails leaves the folders as they were, and one that is repeated gives the
same rows. What a write takes is in proportion to its folders, not to the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import store
from kelpline.sources.scratch import stored

FOLDER = "_bucket"


def _with_folder(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn(FOLDER, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create(df: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write a table; a bucket is a folder of one file, or of several where a file would be too large."""
    dealt = _with_folder(df, keys, buckets).repartition(min(buckets, 10_000), FOLDER)
    dealt.sortWithinPartitions(FOLDER, *keys).write.partitionBy(FOLDER).parquet(path)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    found = spark.read.schema(f"{schema}, {FOLDER} int").parquet(path) if schema else spark.read.parquet(path)
    return found.drop(FOLDER)


def rewrite(spark: SparkSession, path: str, keys: list[str], buckets: int, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the folders that the keys of ``new`` are in by ``merge(old rows of these folders, new)``, which may only
    give rows of them; the numbers of the folders, at most one per bucket. A folder left without rows is kept as an
    empty file."""
    new = stored(_with_folder(new, keys, buckets), "rewritten")
    touched = sorted(r[FOLDER] for r in new.select(FOLDER).distinct().collect())
    if not touched:
        return []
    table = spark.read.parquet(path)
    old = table.filter(F.col(FOLDER).isin(*touched))
    rows = stored(_with_folder(merge(old.drop(FOLDER), new.drop(FOLDER)), keys, buckets), "merged")
    gone = sorted(set(touched) - {r[FOLDER] for r in rows.select(FOLDER).distinct().collect()})
    (rows.select(*table.columns).repartition(min(len(touched), 10_000), FOLDER).sortWithinPartitions(FOLDER, *keys)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(path))
    for folder in gone:
        table.drop(FOLDER).limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/{FOLDER}={folder}")
    return touched


def insert_replace(spark: SparkSession, path: str, keys: list[str], buckets: int, new: DataFrame) -> list[int]:
    """The last writer of a key wins, with the whole row; of several new rows of a key any."""
    return rewrite(spark, path, keys, buckets, new, lambda old, rows: store.insert_replace(old, rows, keys))


def upsert(spark: SparkSession, path: str, keys: list[str], buckets: int, new: DataFrame, keep_if_null: list[str]) -> list[int]:
    """New rows overwrite; a null in ``keep_if_null`` leaves the stored value. ``new`` has a key once."""
    return rewrite(spark, path, keys, buckets, new, lambda old, rows: store.upsert(old, rows, keys, keep_if_null))


def update(spark: SparkSession, path: str, keys: list[str], buckets: int, new: DataFrame) -> list[int]:
    """Set the columns that ``new`` has, for keys that the table holds; other keys of ``new`` are left out."""
    values = [c for c in new.columns if c not in keys]

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        n = rows.select(*keys, F.struct(*values).alias("_new"))
        picked = [(F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c)) if c in values else F.col(c)).alias(c) for c in old.columns]
        return old.join(n, keys, "left").select(*picked)

    return rewrite(spark, path, keys, buckets, new, merge)


def delete(spark: SparkSession, path: str, keys: list[str], buckets: int, gone: DataFrame) -> list[int]:
    return rewrite(spark, path, keys, buckets, gone.select(*keys), lambda old, rows: old.join(rows, keys, "left_anti"))
