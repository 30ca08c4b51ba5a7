"""A maintained full-text index over documents and conversations, held against SQL over the final table.

Batch 0 inserts all documents. Batch 1 doubles the texts of one language, some with a later change, and
inserts all turns of conversations; batch 2 deletes the shorter documents and some keys that never
were."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators import text_index
from kelpline.sources.scratch import scratch_path


#: Where the index over a folder of tables is, by application: it is built once and asked by several queries.
_BUILT: dict[tuple[str, str], str] = {}


def maintained(spark: SparkSession, sf_dir: str) -> str:
    """The index after the three batches; built if this application has not, or if its folder is gone."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known in _BUILT and len(text_index.segments(spark, _BUILT[known])) == 3:
        return _BUILT[known]
    path = scratch_path(spark, "text_index")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("key"), "text", "lang", "n_chars")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((-1 - 1000 * F.col("conv_id") - F.col("turn")).alias("key"), "text")
    change = lambda df, text, deleted, seq: df.select("key", text.alias("text"), F.lit(deleted).alias("deleted"), F.lit(seq).alias("seq"))
    french = docs.filter("lang = 'fr'")
    text_index.apply_changes(change(docs, F.col("text"), False, 0), path, 0)
    first = change(french, F.concat("text", F.lit(" "), "text"), False, 0).unionByName(change(french.filter("n_chars > 2000"), F.concat("text", F.lit(" of the idiot")), False, 1))
    text_index.apply_changes(first.unionByName(change(turns, F.col("text"), False, 0)), path, 1)
    gone = docs.filter("n_chars < 300")
    text_index.apply_changes(change(gone, F.lit(None).cast("string"), True, 0).unionByName(change(gone.select((F.col("key") + 1_000_000_000).alias("key")), F.lit(None).cast("string"), True, 0)), path, 2)
    _BUILT[known] = path
    return path


def index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and a phrase."""
    path = maintained(spark, sf_dir)
    words = text_index.any_word(spark, path, ["idiot", "worthless", "que"]).select(F.col("token").alias("term"), "key", "tf", F.col("length").cast("long").alias("length"))
    return words.unionByName(text_index.phrase(spark, path, ["of", "the"]).select(F.lit("of the").alias("term"), "key", "tf", F.col("length").cast("long").alias("length")))


def index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with one of the words, by statistics that are sums over segments."""
    return text_index.bm25(spark, maintained(spark, sf_dir), ["idiot", "the", "worthless"]).select("key", F.round("rank", 6).alias("rank"))


def index_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most relevant, without scoring all."""
    return text_index.top_words(spark, maintained(spark, sf_dir), ["idiot", "the", "worthless"], 25).rows.select("key", F.round("rank", 6).alias("rank"))


def index_top_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index.top_phrase(spark, maintained(spark, sf_dir), ["of", "the"], 25).rows.select("key", F.round("rank", 6).alias("rank"))


_FINAL = r"""d as (select doc_id as key, case when lang='fr' and n_chars>2000 then text||' of the idiot' when lang='fr' then text||' '||text else text end as text from documents where n_chars is null or n_chars>=300
  union all select -1-1000*conv_id-turn, text from conversations),
tk as materialized (select key, list_filter(string_split_regex(strip_accents(lower(coalesce(text,''))),'[^\p{L}\p{N}]+'), lambda x: x<>'') as t from d),
ix as materialized (select key, len(t) as length, unnest(t) as token, generate_subscripts(t,1) as position from tk),
ph as (select a.key, count(*) as tf, max(a.length) as length from ix a join ix b on a.key=b.key and b.position=a.position+1 where a.token='of' and b.token='the' group by 1),
s as (select count(*) as docs, avg(len(t)) as mean from tk)"""
_PART = "(case when ln((docs-df+0.5)/(df+0.5))>0 then ln((docs-df+0.5)/(df+0.5)) else 1e-6 end)*tf*2.2/(tf+1.2*(0.25+0.75*length/mean))"
_RANKED = f"""h as (select key, token, count(*) as tf, max(length) as length from ix where token in ('idiot','the','worthless') group by 1,2),
f as (select token, count(*) as df from h group by 1), r as (select key, -sum({_PART}) as rank from h join f using (token) cross join s group by 1)"""
ORACLE = {
    "index_hits": f"with {_FINAL} select token as term, key, count(*) as tf, max(length) as length from ix where token in ('idiot','worthless','que') group by 1,2 union all select 'of the', key, tf, length from ph",
    "index_bm25": f"with {_FINAL}, {_RANKED} select key, round(rank,6) as rank from r",
    "index_top_words": f"with {_FINAL}, {_RANKED} select key, round(rank,6) as rank from r order by r.rank, key limit 25",
    "index_top_phrase": f"with {_FINAL}, r as (select key, -({_PART}) as rank from ph cross join s cross join (select count(*) as df from ph)) select key, round(rank,6) as rank from r order by r.rank, key limit 25",
}
QUERIES = {f.__name__: f for f in (index_hits, index_bm25, index_top_words, index_top_phrase)}
