"""Manifest and audit of an export: order of files, senders, first references, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions.rules import size_bucket
from kelpline.functions.text import is_photo_ref, is_thumb
from kelpline.operators import scan


def photo_refs(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct references to photos in raw pages."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)photos/[^\"'<>\n]+?\.jpg"), F.lit(0))
    return pages.select(F.explode(found).alias("ref")).distinct()


def ref_counts(refs: DataFrame) -> DataFrame:
    return refs.agg(F.count("*").alias("raw_refs"), F.count_if(is_thumb(F.col("ref"))).alias("thumbs"), F.count_if(is_photo_ref(F.col("ref"))).alias("photos"))


def carried_sender(messages: DataFrame, by: list[str], order: list[str], sender: str = "from_name", begins: Column | None = None) -> DataFrame:
    """``sender_name``: the name of the last message that has a name element, within a file. A
    name element that is empty makes it null, so it isn't the last non-null name. A file of any
    length is dealt to all tasks."""
    begins = F.col(sender).isNotNull() if begins is None else begins
    return scan.last_marked(messages, by, order, begins, F.nullif(F.col(sender), F.lit("")), "sender_name")


def first_seen(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key over all files. A minimum, not a window: a key's rows need not meet."""
    place = F.struct(*order)
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), place).alias("_row"))
    return first.select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns])


def manifest_summary(manifest: DataFrame, refs: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Counts only: no caption or sender leaves the manifest. ``duplicates``: the skipped references."""
    caption = F.coalesce("caption", F.lit(""))
    m = manifest.agg(F.count("*").alias("records"), F.count_if(caption != "").alias("captions"), F.count_if(F.length(caption) > 100).alias("captions_over_100"), F.coalesce(F.max(F.length(caption)), F.lit(0)).alias("longest_caption"), F.count_if("parse_error").alias("parse_errors"))
    d = duplicates.agg(F.count("*").alias("duplicate_refs"))
    return m.crossJoin(F.broadcast(ref_counts(refs))).crossJoin(F.broadcast(d)).withColumn("candidates", F.col("records") + F.col("duplicate_refs"))


def size_stats(df: DataFrame, size: str) -> DataFrame:
    """Mean, least and greatest size in KB, to two places."""
    kb = F.col(size) / 1024.0
    return df.filter(F.col(size).isNotNull()).agg(F.round(F.sum(F.col(size).cast("long")) / F.count("*") / 1024.0, 2).alias("avg_kb"), F.round(F.min(kb), 2).alias("min_kb"), F.round(F.max(kb), 2).alias("max_kb"))


def side_histogram(df: DataFrame, side: str = "max_side") -> DataFrame:
    return df.select(size_bucket(F.col(side)).alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def audit_record(files: DataFrame, least_side: int = 800) -> DataFrame:
    """Audit rows of files with filename, content (null if missing), width, height (-1 if it can't
    be decoded). Corrupt files keep hash and size; low_res holds for sound files only."""
    there = F.col("content").isNotNull()
    corrupt = ~there | (F.coalesce("width", F.lit(-1)) <= 0)
    side = lambda c: F.when(~corrupt, F.col(c)).cast("int")
    most = F.greatest(side("width"), side("height"))
    return files.select("filename", F.when(there, F.sha2("content", 256)).alias("sha256"), side("width").alias("width"), side("height").alias("height"), most.alias("max_side"), F.when(there, F.length("content")).cast("long").alias("file_size"), F.coalesce(most < least_side, F.lit(False)).alias("low_res"), corrupt.alias("corrupt"))


def audit_summary(audit: DataFrame, duplicates: DataFrame) -> DataFrame:
    flags = audit.agg(F.count("*").alias("total"), F.count_if("corrupt").alias("corrupt"), F.count_if("low_res").alias("low_res"))
    return flags.crossJoin(F.broadcast(duplicates)).crossJoin(F.broadcast(size_stats(audit, "file_size")))


def runs(df: DataFrame, by: list[str], order: list[str], value: Column, text: Column, glue: str = "\n") -> DataFrame:
    """Neighbouring rows of one value as one: by, run, value, n, joined text. Runs are numbered by a
    scan over ranges; only the rows of one run meet, as their text is one."""
    marked = scan.run_numbers(df.select(*by, *[c for c in order if c not in by], value.alias("_run_value"), text.alias("_text")), by, order, F.col("_run_value"), "run")
    place = F.struct(*order)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("o"), F.col("_text").alias("t")))), lambda x: x["t"]), glue)
    return marked.groupBy(*by, "run").agg(F.first("_run_value").alias("value"), F.count("*").alias("n"), joined.alias("text"))


def last_runs(run_rows: DataFrame, by: list[str], most: int = 30) -> DataFrame:
    """The last runs of a key. Spark keeps no more than ``most`` of a key in each task before they meet."""
    w = Window.partitionBy(*by).orderBy(F.col("run").desc())
    return run_rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def streaks(df: DataFrame, by: list[str], order: list[str], failed: Column) -> DataFrame:
    """``errors``: failures in a row up to each row; a success sets it to zero, and so does a row of unknown outcome."""
    return scan.since(df, by, order, ~F.coalesce(failed, F.lit(False)), "errors")
