"""Scans over the rows of a key in order, without one task for a key.

Rows are dealt by ranges of key and order, so a key with most rows lies in many neighbouring
ranges. Each range is scanned by itself; what it hands on is one summary row per key that goes on
in the next range, at most two per range. Summaries of a key are scanned in order of ranges, which
gives what each range begins with, and that is joined back to its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from kelpline.sources.scratch import stored

#: The range of a row.
PART = "_range"


@dataclass
class Ranges:
    """Rows dealt by ranges: task k has range k, sorted by key and order."""

    rows: DataFrame
    by: list[str]
    order: list[str]

    def inside(self) -> WindowSpec:
        """The rows of a key in a range, in order."""
        return Window.partitionBy(PART, *self.by).orderBy(*self.order)

    def place(self) -> Column:
        return F.struct(*self.order)

    def with_carry(self, summary: list[Column], over) -> DataFrame:
        """The rows, each with what ``over`` makes of the ranges before it. ``summary``: aggregates of the rows
        of a key in a range. ``over``: from the frame of summaries, the window of a key's ranges
        in order, to the frame with the columns that are carried; only these are joined to the
        rows, and are null in rows of keys that begin in their range."""
        each = self.rows.groupBy(PART, *self.by).agg(*summary)
        key = F.struct(*self.by)
        ends = each.groupBy(PART).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
        some = stored(each.join(F.broadcast(ends), PART).filter((key == F.col("_low")) | (key == F.col("_high"))).drop("_low", "_high"), "summaries")
        known = set(some.columns)
        carried = over(some, Window.partitionBy(*self.by).orderBy(PART))
        more = [c for c in carried.columns if c not in known]
        carried = carried.filter(F.coalesce(*[F.col(c).isNotNull() for c in more], F.lit(False))).select(F.col(PART).alias("_carried"), *[F.col(c).alias(f"_carried_{c}") for c in self.by], *more)
        same = F.col(PART) == F.col("_carried")
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"_carried_{c}"))
        return self.rows.join(F.broadcast(carried), same, "left").drop("_carried", *[f"_carried_{c}" for c in self.by])


def ranged(df: DataFrame, by: list[str], order: list[str]) -> Ranges:
    """Deal the rows by ranges of key and order, a range per task; rows equal in both stay together."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()), "ranges")
    return Ranges(dealt.repartitionById(n, F.col(PART)), by, order)


def before(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def last_marked(df: DataFrame, by: list[str], order: list[str], mark: Column, value: Column, out: str) -> DataFrame:
    """``out``: the value of the last row so far, of the same key, where ``mark`` holds; null before the first one. The value itself may be null."""
    r = ranged(df.withColumn("_marked", F.when(mark, F.struct(value.alias("v")))), by, order)

    def over(some: DataFrame, w: WindowSpec) -> DataFrame:
        return some.withColumn("_carry", F.last("_last", ignorenulls=True).over(before(w)))

    rows = r.with_carry([F.max_by("_marked", F.when(F.col("_marked").isNotNull(), r.place())).alias("_last")], over)
    own = F.last("_marked", ignorenulls=True).over(so_far(r.inside()))
    return rows.withColumn(out, F.coalesce(own, F.col("_carry"))["v"]).drop("_marked", "_carry", PART)


def run_numbers(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """``out``: number, from 1, of the run of equal values that a row belongs to among the rows of its key; nulls are equal."""
    r = ranged(df.withColumn("_value", F.struct(value.alias("v"))), by, order)
    w = r.inside()
    own = Ranges(r.rows.withColumn("_turn", (~F.lag("_value").over(w).eqNullSafe(F.col("_value")) & (F.row_number().over(w) > 1)).cast("long")), by, order)

    def over(some: DataFrame, w: WindowSpec) -> DataFrame:
        new = some.withColumn("_new", (~F.lag("_last").over(w).eqNullSafe(F.col("_first"))).cast("long"))
        return new.withColumn("_carry", F.coalesce(F.sum(F.col("_turns") + F.col("_new")).over(before(w)), F.lit(0)) + F.col("_new")).drop("_new")

    rows = own.with_carry([F.min_by("_value", own.place()).alias("_first"), F.max_by("_value", own.place()).alias("_last"), F.sum("_turn").alias("_turns")], over)
    return rows.withColumn(out, F.coalesce("_carry", F.lit(1)) + F.sum("_turn").over(so_far(own.inside()))).drop("_value", "_turn", "_carry", PART)


def since(df: DataFrame, by: list[str], order: list[str], reset: Column, out: str) -> DataFrame:
    """``out``: how many rows of its key have come up to a row since the last one where ``reset`` holds, which has 0."""
    r = ranged(df.withColumn("_reset", F.coalesce(reset, F.lit(False))), by, order)
    w = r.inside()
    at = Ranges(r.rows.withColumn("_at", F.row_number().over(w).cast("long")), by, order)

    def over(some: DataFrame, w: WindowSpec) -> DataFrame:
        tail = some.withColumn("_tail", F.col("_n") - F.coalesce("_reset_at", F.lit(0))).withColumn("_group", F.sum(F.col("_reset_at").isNotNull().cast("int")).over(so_far(w)))
        ended = tail.withColumn("_ended", F.sum("_tail").over(so_far(Window.partitionBy(*by, "_group").orderBy(PART))))
        return ended.withColumn("_carry", F.coalesce(F.lag("_ended").over(w), F.lit(0))).drop("_tail", "_group", "_ended")

    rows = at.with_carry([F.count("*").alias("_n"), F.max(F.when(F.col("_reset"), F.col("_at"))).alias("_reset_at")], over)
    last = F.max(F.when(F.col("_reset"), F.col("_at"))).over(so_far(at.inside()))
    return rows.withColumn(out, F.col("_at") - F.coalesce(last, -F.coalesce("_carry", F.lit(0)))).drop("_reset", "_at", "_carry", PART)
