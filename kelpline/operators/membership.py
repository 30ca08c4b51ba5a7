"""A stored filter of known keys, which tells most new keys apart before anything is shuffled.

A blocked Bloom filter: a key's hash names a block of 512 bits and six bits in it. Blocks are rows, built
by aggregates; a batch of keys has a filter of its own, and several filters are asked in turn. A
row that a filter says is new is new; what may be known goes through an exact anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY, BLOCK_BITS, HASHES = 12, 512, 6
#: Bytes of filters that are broadcast; where they are larger all rows go through the join.
MOST_BYTES = 64 << 20


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def _places(key: Column) -> list[Column]:
    """Six places of 0..511, from the bits of a second hash."""
    h = F.xxhash64(key, F.lit("filter"))
    return [F.shiftrightunsigned(h, 9 * i).bitwiseAND(BLOCK_BITS - 1).cast("int") for i in range(HASHES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))


def write_filter(keys: DataFrame, key: str, path: str) -> int:
    """Store the filter of a batch of keys as (block, words, blocks); how many blocks it has. Nulls are in no filter."""
    keys = keys.select(F.col(key).alias("k")).filter("k is not null")
    blocks = max(1, -(-keys.count() * BITS_PER_KEY // BLOCK_BITS))
    places = keys.select(_block(F.col("k"), F.lit(blocks)).alias("block"), *[p.alias(f"p{i}") for i, p in enumerate(_places(F.col("k")))])
    none = F.lit(0).cast("long")

    def word(w: int) -> Column:
        own = [F.when(F.shiftright(f"p{i}", 6) == w, _bit(F.col(f"p{i}"))).otherwise(none) for i in range(HASHES)]
        return F.bit_or(reduce(lambda a, b: a.bitwiseOR(b), own)).alias(f"w{w}")

    words = places.groupBy("block").agg(*[word(w) for w in range(BLOCK_BITS // 64)])
    words.select("block", F.array(*[f"w{w}" for w in range(BLOCK_BITS // 64)]).alias("words"), F.lit(blocks).cast("long").alias("blocks")).write.mode("overwrite").parquet(path)
    return blocks


def maybe_known(rows: DataFrame, key: str, spark: SparkSession, paths: list[str]) -> DataFrame:
    """``rows`` with ``_maybe``: whether one of the filters can't rule the key out. Each filter is broadcast."""
    out = rows.withColumn("_maybe", F.lit(False))
    for path in paths:
        table = spark.read.parquet(path)
        blocks = table.agg(F.max("blocks")).first()[0]
        if blocks is None:
            continue
        joined = out.withColumn("_block", _block(F.col(key), F.lit(blocks))).join(F.broadcast(table.select(F.col("block").alias("_block"), "words")), "_block", "left")
        has = reduce(lambda a, b: a & b, [F.element_at("words", F.shiftright(p, 6) + 1).bitwiseAND(_bit(p)) != 0 for p in _places(F.col(key))])
        out = joined.withColumn("_maybe", F.col("_maybe") | F.coalesce(F.col(key).isNotNull() & has, F.lit(False))).drop("_block", "words")
    return out


def split(rows: DataFrame, key: str, known: DataFrame, paths: list[str], most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(new, maybe): rows whose key the filters of ``known`` rule out, and those that must be looked up. With filters
    larger than the bound all must be."""
    spark = rows.sparkSession
    size = sum(spark.read.parquet(p).count() for p in paths) * (BLOCK_BITS // 8 + 24)
    if not paths or size > most_bytes:
        return rows.limit(0), rows
    tested = maybe_known(rows, key, spark, paths)
    return tested.filter("not _maybe").drop("_maybe"), tested.filter("_maybe").drop("_maybe")


def unseen(rows: DataFrame, key: str, known: DataFrame, paths: list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """Rows whose key isn't in ``known`` (a column of that name), exactly: only what the filters let pass is shuffled for the anti join."""
    new, maybe = split(rows, key, known, paths, most_bytes)
    return new.unionByName(maybe.join(known.select(key).distinct(), key, "left_anti"))
