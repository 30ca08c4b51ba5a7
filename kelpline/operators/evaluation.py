"""Confusion matrices, precision and recall, and acceptance gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, true: str, pred: str, classes: list[str]) -> DataFrame:
    """(actual, pred, n) for every pair of classes. Pairs with another label are left out, so they
    lower neither recall nor accuracy."""
    known = df.filter(F.col(true).isin(*classes) & F.col(pred).isin(*classes))
    n = known.groupBy(F.col(true).alias("actual"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    names = F.array(*map(F.lit, classes))
    cells = df.sparkSession.range(1).select(F.explode(names).alias("actual")).select("actual", F.explode(names).alias("pred"))
    return cells.join(n, ["actual", "pred"], "left").select("actual", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def matrix(cells: DataFrame, classes: list[str]) -> DataFrame:
    """A row per true class, a column per predicted one."""
    return cells.groupBy("actual").pivot("pred", classes).agg(F.sum("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(cells: DataFrame) -> DataFrame:
    """precision, recall, f1 and support by class; 0 where a denominator is."""
    hit = F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0))
    rows = cells.groupBy(F.col("actual").alias("cls")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    cols = cells.groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("predicted"))
    m = rows.join(cols, "cls").select("cls", _ratio(F.col("tp"), F.col("predicted")).alias("precision"), _ratio(F.col("tp"), F.col("support")).alias("recall"), "support")
    return m.select("cls", "precision", "recall", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def averages(metrics: DataFrame, cells: DataFrame) -> DataFrame:
    """Means over classes, means by support, and accuracy; one row."""
    kinds = ("precision", "recall", "f1")
    macro = [F.coalesce(F.avg(k), F.lit(0.0)).alias(f"macro_{k}") for k in kinds]
    weighted = [_ratio(F.sum(F.col(k) * F.col("support")), F.sum("support")).alias(f"weighted_{k}") for k in kinds]
    right = cells.agg(_ratio(F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return metrics.agg(*macro, *weighted).crossJoin(F.broadcast(right))


def pair_confusion(cells: DataFrame, a: str, b: str) -> DataFrame:
    """How often two classes are taken for one another, and how often a is taken for b."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    t, p = F.col("actual"), F.col("pred")
    both = _ratio(n((t == a) & (p == b)) + n((t == b) & (p == a)), n(t.isin(a, b)))
    return cells.agg(both.alias("confusion_rate"), _ratio(n((t == a) & (p == b)), n(t == a)).alias("leak_rate"))


def recall_gate(metrics: DataFrame, cls: str, least: float) -> DataFrame:
    value = F.coalesce(F.max(F.when(F.col("cls") == cls, F.col("recall"))), F.lit(0.0))
    return metrics.agg(F.lit(f"{cls}_recall").alias("gate"), value.alias("value"), (value >= least).alias("passed"), F.lit("").alias("detail"))


def rate_gate(cells: DataFrame, name: str, a: str, b: str, most: float, both_ways: bool) -> DataFrame:
    rate = pair_confusion(cells, a, b).select(F.col("confusion_rate" if both_ways else "leak_rate").alias("value"))
    return rate.select(F.lit(name).alias("gate"), "value", (F.col("value") < most).alias("passed"), F.lit("").alias("detail"))


def worst_class_gate(metrics: DataFrame, least: float, without: tuple[str, ...]) -> DataFrame:
    """The least recall of all classes, absent ones as zero; only classes with samples can fail."""
    m = metrics.filter(~F.col("cls").isin(*without)) if without else metrics
    failing = (F.col("recall") < least) & (F.col("support") > 0)
    names = F.array_join(F.array_sort(F.collect_list(F.when(failing, F.concat("cls", F.lit("="), F.format_string("%.2f", "recall"))))), ", ")
    return m.agg(F.lit("per_class_recall_min").alias("gate"), F.least(F.coalesce(F.min("recall"), F.lit(1.0)), F.lit(1.0)).alias("value"), (F.count_if(failing) == 0).alias("passed"), F.when(F.count_if(failing) > 0, F.concat(names, F.lit(" fail"))).otherwise("").alias("detail"))


def rejection_gate(df: DataFrame, pred: str, unknown: str, least: float) -> DataFrame:
    """Share of all predictions, of other labels too, that are ``unknown``."""
    value = _ratio(F.count_if(F.col(pred) == unknown), F.count("*"))
    return df.agg(F.lit("unknown_rejection_rate").alias("gate"), value.alias("value"), (value >= least).alias("passed"), F.lit("").alias("detail"))


def gates(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def all_passed(gate_rows: DataFrame) -> DataFrame:
    """No gates, as with empty input, pass."""
    return gate_rows.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("all_passed"))


def tally(df: DataFrame, expected: str, ok: Column) -> DataFrame:
    return df.groupBy(expected).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def accuracy_by_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """To four places; classes without samples have no row."""
    return df.groupBy(true).agg(F.count("*").alias("samples"), F.round(F.count_if(F.col(true) == F.col(pred)) / F.count("*"), 4).alias("accuracy"))
