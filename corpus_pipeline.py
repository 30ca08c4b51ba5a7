"""From raw documents to packed training sequences.

Five stages, each over all that its predecessor kept: toxic documents go; of each group of
near duplicates the document of the least doc_id stays; passages of the benchmark are cut
out of the texts; secrets are replaced by a word; what is left is packed into sequences.
Between stages the documents are written as Parquet into the folder that the session's
``spark.checkpoint.dir`` names, so that a lost executor costs one stage at most.

Nulls: a null text is not toxic, is a near duplicate of other wordless texts, and is packed
as an empty one. A null doc_id stays only if its group has no other. Each group is one row
after the second stage, also where rows share a doc_id, or a doc_id and a text. An empty table gives no rows. Columns beyond
those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import common, decontaminate, packing, secrets, similar, toxicity

#: No stage is expressible in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half. Null and empty texts stay, repeated rows are judged
    each, a long text is scored whole, an empty table stays empty, and all columns are kept."""
    common.tune(spark)
    scorer = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = common.unused(docs.columns, "_toxicity")
    return toxicity.scored(docs, scorer, score).filter(F.col(score) < 0.5).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents whose five-word shingles are alike to 0.8 or more: that of
    the least doc_id, and of rows that share it the one of the least md5 of its text. Rows are
    told apart by doc_id and text, so that a repeated or null doc_id keeps no other text; of
    rows that repeat both, the one whose JSON form is least stays. Null and wordless texts are
    one group; other columns may have any names and types; an empty table stays empty."""
    kept = similar.similar_documents(docs).filter("stays").select("doc_id", "text_md5", (F.col("n") > 1).alias("again"))
    rows = common.as_row(docs).withColumn("md5", F.md5("_row.text"))
    left = rows.join(kept, F.col("_row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("md5").eqNullSafe(F.col("text_md5"))).select("_row", "doc_id", "md5", "again")
    once = left.filter("again").groupBy("doc_id", "md5").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row")
    return left.filter("not again").select("_row").unionByName(once).select(*common.from_row(docs.columns))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that the benchmark holds. Null and empty texts stay as they are,
    and so do rows that repeat; all columns are kept, whatever their names."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced; all rows and columns stay (``secrets.redact``)."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences: null and empty texts make one piece, repeated rows
    as many as there are, long texts several, and an empty table none (``packing.best_fit_packing``)."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("toxicity", keep_civil),
    ("simhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", cut_benchmark),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
