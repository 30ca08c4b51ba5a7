"""Numbers in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.sources.scratch import stored


def numbered(df: DataFrame, by: str, out: str, first: int = 1) -> DataFrame:
    """``out``: place of each row in the order of ``by`` (distinct values), from ``first``. Rows are
    dealt by ranges and sorted there; a row's place is its place in its range plus the sizes of
    the ranges before, of which there are as many as partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, by).sortWithinPartitions(by).withColumn("_numbered_id", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("_numbered_range", F.shiftright("_numbered_id", 33)).withColumn("_numbered_at", F.col("_numbered_id").bitwiseAND((1 << 33) - 1)), "numbered")
    before = Window.orderBy("_numbered_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_numbered_range").agg(F.count("*").alias("_numbered_n")).select("_numbered_range", F.coalesce(F.sum("_numbered_n").over(before), F.lit(0)).alias("_numbered_before"))
    return dealt.join(F.broadcast(sizes), "_numbered_range").withColumn(out, F.col("_numbered_before") + F.col("_numbered_at") + first).drop("_numbered_id", "_numbered_range", "_numbered_at", "_numbered_before")
