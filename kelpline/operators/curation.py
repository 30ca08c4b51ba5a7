"""Datasets of labelled images: splits, class counts and coverage, label files, augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions.rules import coverage_tier
from kelpline.operators.order import numbered


def split_sizes(n: Column, train: float = 0.7, val: float = 0.15) -> tuple[Column, Column]:
    """Sizes of train and val: at least one each; val gives one up if nothing is left for test."""
    t = F.greatest(F.lit(1), F.floor(n * train).cast("int"))
    v = F.greatest(F.lit(1), F.floor(n * val).cast("int"))
    return t, F.when(n - t - v < 1, F.greatest(F.lit(0), F.least(v - 1, n - t))).otherwise(v)


def stratified_split(df: DataFrame, cls: str, key: str, seed: str = "42", train: float = 0.7, val: float = 0.15, buckets: int = 256) -> DataFrame:
    """``split`` of each row: by class, in the order of a hash of the key. Ranks go by buckets of
    the hash's first byte, so no task holds a whole class."""
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.withColumn("_code", code).withColumn("_bucket", F.substring("_code", 1, 2))
    counts = rows.groupBy(cls, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(cls).orderBy("_bucket")
    counts = counts.select(cls, "_bucket", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(cls)).alias("_all"))
    rank = F.row_number().over(Window.partitionBy(cls, "_bucket").orderBy("_code", key)) + F.col("_before")
    t, v = split_sizes(F.col("_all"), train, val)
    rows = rows.join(counts, [cls, "_bucket"]).withColumn("_rank", rank)
    return rows.withColumn("split", F.when(F.col("_rank") <= t, "train").when(F.col("_rank") <= t + v, "val").otherwise("test")).select(*df.columns, "split")


def class_counts(df: DataFrame, cls: str, *also: str) -> DataFrame:
    return df.groupBy(cls, *also).agg(F.count("*").alias("n"))


def class_weights(counts: DataFrame) -> DataFrame:
    """Total over classes times count; 1 where a class has none."""
    whole = counts.agg(F.sum("n").alias("_total"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(whole)).withColumn("weight", F.when(F.col("n") == 0, 1.0).otherwise(F.col("_total") / (F.col("_k") * F.col("n")))).drop("_total", "_k")


def balance(counts: DataFrame, cls: str, order: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """Greatest over least count of the classes that have any, with their names (the first of
    equal ones), and whether that is too uneven."""
    some = counts.filter(F.col("n") > 0)
    if without:
        some = some.filter(~F.col(cls).isin(*without))
    out = some.agg(F.max_by(cls, F.struct(F.col("n"), -order)).alias("largest"), F.min_by(cls, F.struct(F.col("n"), order)).alias("smallest"), (F.max("n") / F.min("n")).alias("ratio"))
    return out.withColumn("uneven", F.coalesce(F.col("ratio") > 3.0, F.lit(False)))


def coverage(counts: DataFrame, cls: str, special: str = "unknown_fish") -> DataFrame:
    return counts.withColumn("tier", coverage_tier(F.col("n"), F.col(cls), special))


def inactive(covered: DataFrame, cls: str) -> DataFrame:
    return covered.filter("tier = 'empty'").select(cls).unionByName(covered.filter("tier = 'weak'").select(cls))


def absent(expected: DataFrame, present: DataFrame, cls: str) -> DataFrame:
    return expected.select(cls).join(present.select(cls).distinct(), cls, "left_anti")


def blocked(counts: DataFrame, most_empty: int = 2) -> DataFrame:
    return counts.agg(F.count_if(F.col("n") == 0).alias("empty_classes"), (F.count_if(F.col("n") == 0) > most_empty).alias("blocked"))


def dominant_class(boxes: DataFrame, image: str, cls: str, area: Column, line: Column) -> DataFrame:
    """The class of the largest box of each image, the first of equal ones; boxes without area don't count."""
    rows = boxes.withColumn("_area", area).filter("_area > 0")
    return rows.groupBy(image).agg(F.max_by(cls, F.struct(F.col("_area"), -line)).alias("dominant"))


def top_detection(boxes: DataFrame, image: str, cls: str, confidence: str, line: Column, least: float) -> DataFrame:
    """The class of the surest box, and how many of class 0 are sure enough."""
    return boxes.groupBy(image).agg(F.max_by(cls, F.struct(F.col(confidence), -line)).alias("top"), F.max(confidence).alias("top_confidence"), F.count_if((F.col(cls) == 0) & (F.col(confidence) >= least)).alias("wholes"))


def label_errors(lines: DataFrame, file: str, line_no: str, text: str, classes: int) -> DataFrame:
    """(file, line, error) of label lines: five fields, a class in range, four numbers in [0, 1].
    Blank lines are skipped."""
    rows = lines.filter(F.trim(text) != "").withColumn("_parts", F.split(F.trim(text), r"\s+"))
    parts = F.col("_parts")
    rows = rows.withColumn("_kind", F.try_element_at(parts, F.lit(1)).try_cast("int")).withColumn("_numbers", F.slice(parts, 2, 4).try_cast("array<double>"))
    kind, numbers = F.col("_kind"), F.col("_numbers")
    bad = F.exists(numbers, lambda x: x.isNull()) | (F.size(numbers) < 4)
    found = (
        F.when(F.size(parts) != 5, F.array(F.lit("fields")))
        .when(kind.isNull(), F.array(F.lit("class not a number")))
        .otherwise(F.array_compact(F.array(F.when(~kind.between(0, classes - 1), "class out of range"), F.when(bad, "not a number"), F.when(~bad & F.exists(numbers, lambda x: ~x.between(0.0, 1.0)), "out of [0, 1]"))))
    )
    return rows.select(file, line_no, F.explode(found).alias("error"))


def without_label(images: DataFrame, labels: DataFrame, stem: str) -> DataFrame:
    return images.join(labels.select(stem).distinct(), stem, "left_anti")


def capped_report(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first few rows of each group with the number of those left out."""
    w = Window.partitionBy(*by)
    place, n = F.row_number().over(w.orderBy(*order)), F.count("*").over(w)
    return df.withColumn("_place", place).withColumn("left_out", F.greatest(n - most, F.lit(0))).filter(F.col("_place") <= most).drop("_place")


def unseen(new: DataFrame, known: DataFrame, code: str, *order: Column) -> DataFrame:
    """The first file of each content hash that isn't known yet."""
    fresh = new.join(known.select(code).distinct(), code, "left_anti").groupBy(code).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("_row"))
    return fresh.select(*[F.col(f"_row.{c}").alias(c) for c in new.columns])


def augmentation_plan(sources: DataFrame, key: str, wanted: int, transforms: int = 8) -> DataFrame:
    """(i, source, transform, pass): images made by going round the sources, then the transforms."""
    ranked = numbered(sources.filter(~F.col(key).contains("_aug_")).select(key), key, "_at", 0)
    n = ranked.agg(F.count("*").alias("_n"))
    plan = sources.sparkSession.range(wanted).withColumnRenamed("id", "i").crossJoin(F.broadcast(n)).filter("_n > 0")
    plan = plan.select("i", (F.col("i") % F.col("_n")).alias("_at"), F.expr(f"cast(i div _n % {transforms} as int)").alias("transform"), F.expr(f"i div (_n * {transforms})").alias("pass"))
    return plan.join(ranked.select("_at", F.col(key).alias("source")), "_at").select("i", "source", "transform", "pass")


def filled_up(primary: DataFrame, secondary: DataFrame, url: str, order: str, most: int) -> DataFrame:
    """Results of the first source, then of the second, each address once, the first few."""
    both = primary.withColumn("_source", F.lit(1)).unionByName(secondary.withColumn("_source", F.lit(2)))
    once = both.groupBy(url).agg(F.min(F.struct("_source", order, *[c for c in primary.columns if c not in (url, order)])).alias("_row"))
    flat = once.select(url, "_row.*").orderBy("_source", order).limit(most)
    return flat.select(*primary.columns)


def disk_usage(files: DataFrame, size: str) -> DataFrame:
    return files.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
