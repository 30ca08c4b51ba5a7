"""A full-text index that follows inserts, updates and deletes without being rebuilt.

Every batch of changes becomes one segment that is never written again:

* ``postings``: (token, block) rows with the documents of a block that hold the token, their lengths
  and positions, and the greatest count and least length among them. Blocks are runs by ascending
  length of the documents that one task has, so that least lengths are close to all lengths. A
  block's postings are made from its texts by that task: single places of tokens are never shuffled.
* ``documents``: (key, length, tokens) of the batch's texts, in folders by a hash of the key; the
  different tokens stand in one string.
* ``gone``: (key, segment) of what the batch replaced or deleted. A posting counts while its key and
  segment aren't there.
* ``frequencies``: by token how many more documents hold it after the batch, negative if fewer.

A row of ``log`` with the changes in the number of documents and of their tokens, written last, makes a
segment part of the index; a batch that failed half way is written again over what it left, and
one that is in the log is not applied twice. So statistics are sums over segments and a query
reads postings, not texts. ``compact`` writes what is left as one new segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.operators.search import B, K1, LEAST_IDF, tokens_of
from kelpline.sources.scratch import stored

#: Documents of a block; bytes of text for a folder of tokens or keys; blocks of a token that a task writes.
BLOCK, FOLDER_BYTES, RUN = 128, 128 << 20, 4096
_LOG = "segment long, batch long, replaces long, docs long, tokens long, blocks long, folders int"
#: Of the documents of a block: keys, lengths, and where their positions start in those of the block and how many they are.
_BLOCKS = "token string, block long, most_tf int, least_length int, docs int, keys array<long>, lengths array<int>, starts array<int>, counts array<int>, positions array<int>"
_POSTINGS = f"{_BLOCKS}, folder int"
_DOCUMENTS = "key long, length int, tokens string, folder int"
#: A block's number is that of its task, shifted, and its place there.
_TASK_BITS = 32


@dataclass
class Segment:
    segment: int
    batch: int
    docs: int
    tokens: int
    blocks: int
    folders: int


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """The log: a row per batch since the last compaction. Without a folder there are none."""
    try:
        rows = spark.read.schema(_LOG).json(f"{path}/log/*").orderBy("segment").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    begins = max((r["replaces"] for r in rows), default=-1)  # a compacted segment stands for all up to this one
    return [Segment(**{k: v for k, v in r.asDict().items() if k != "replaces"}) for r in rows if r["segment"] > begins]


def _words(c: str) -> Column:
    """Of tokens in one string."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def _entries() -> Column:
    """A posting row's documents as structs of key, length and positions."""
    each = F.arrays_zip("keys", "lengths", "starts", "counts")
    return F.transform(each, lambda e: F.struct(e["keys"].alias("key"), e["lengths"].alias("length"), F.slice("positions", e["starts"] + 1, e["counts"]).alias("positions")))


def _folder(c: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(folders)).cast("int")


def _part(spark: SparkSession, path: str, kind: str, schema: str, of: list[Segment]) -> DataFrame:
    """Rows of some segments, with their ``segment``."""
    parts = [spark.read.schema(schema).parquet(f"{path}/{kind}/segment={s.segment}").withColumn("segment", F.lit(s.segment).cast("long")) for s in of]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, segment long")


def _write(df: DataFrame, path: str, kind: str, number: int, *by: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{path}/{kind}/segment={number}")


def _folders_of(keys: DataFrame, folders: int) -> list[int]:
    """The folders that hold the keys; there is one for each 128 MB of text."""
    return [0] if folders == 1 else [r["f"] for r in keys.select(_folder(F.col("key"), folders).alias("f")).distinct().collect()]


def live_documents(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, segment, length, tokens) of the documents in the index, or of those of ``keys`` (key)."""
    of = segments(spark, path)
    if keys is None:
        docs = _part(spark, path, "documents", _DOCUMENTS, of)
    else:
        parts = [_part(spark, path, "documents", _DOCUMENTS, [s]).filter(F.col("folder").isin(*_folders_of(keys, s.folders))) for s in of]
        docs = (reduce(DataFrame.unionByName, parts) if parts else _part(spark, path, "documents", _DOCUMENTS, [])).join(keys.select("key").distinct(), "key", "left_semi")
    docs = docs.select("key", "segment", "length", _words("tokens").alias("tokens"))
    return docs.join(_part(spark, path, "gone", "key long, gone_segment long", of).select("key", F.col("gone_segment").alias("segment")), ["key", "segment"], "left_anti")


def apply_changes(changes: DataFrame, path: str, batch: int, block: int = BLOCK, folder_bytes: int = FOLDER_BYTES) -> bool:
    """Apply a batch of changes (key long, text, deleted boolean, seq), numbered upwards; of several
    changes of a key the one of the greatest seq counts. To insert, update or delete a key that is
    or isn't there is all the same. False if the log has that batch or a later one already. Null
    texts are documents without tokens; rows without a key are left out."""
    spark = changes.sparkSession
    of = segments(spark, path)
    if any(s.batch >= batch for s in of):
        return False
    last = changes.filter("key is not null").groupBy("key").agg(F.max_by(F.struct("text", F.coalesce("deleted", F.lit(False)).alias("deleted")), "seq").alias("_c"))
    words = F.when(~F.col("_c.deleted"), F.array_join(tokens_of(F.coalesce("_c.text", F.lit(""))), " "))
    last = stored(last.select("key", words.alias("words")), "changes", "zstd")
    old = stored(live_documents(spark, path, last), "replaced", "zstd")
    _segment(last.filter("words is not null"), old, path, of[-1].segment + 1 if of else 0, batch, -1, block, folder_bytes)
    return True


def compact(spark: SparkSession, path: str, block: int = BLOCK, folder_bytes: int = FOLDER_BYTES) -> int | None:
    """Write the documents that are left, from their postings, as one segment that stands for all before. Older folders stay for
    readers that began before; they can be removed later."""
    of = segments(spark, path)
    if not of:
        return None
    number = of[-1].segment + 1
    docs = live_documents(spark, path)
    each = live_postings(spark, path).select("key", "segment", "token", F.explode("positions").alias("at"))
    words = each.groupBy("key", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("words"))
    words = docs.select("key", "segment").join(words, ["key", "segment"], "left").select("key", F.coalesce(F.array_join("words", " "), F.lit("")).alias("words"))
    _segment(stored(words, "compacted", "zstd"), None, path, number, max(s.batch for s in of), of[-1].segment, block, folder_bytes)
    return number


def _segment(fresh: DataFrame, old: DataFrame | None, path: str, number: int, batch: int, replaces: int, block: int, folder_bytes: int) -> None:
    """Write a segment of ``fresh`` (key, words in one string) that takes the place of ``old`` documents, and log it."""
    spark = fresh.sparkSession
    length = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1)
    placed = fresh.select("key", "words", length.cast("int").alias("length"))
    total = placed.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first()
    folders = max(1, -(-total["bytes"] // folder_bytes))
    # a token's blocks are dealt to several tasks where there are many
    runs = max(1, -(-total["docs"] // (block * RUN)))
    rows = placed.sortWithinPartitions("length", "key").mapInArrow(_inverted(block), _BLOCKS).withColumn("folder", _folder(F.col("token"), folders))
    rows = rows.repartition("folder", F.pmod(F.shiftright("block", _TASK_BITS), F.lit(runs))).sortWithinPartitions("folder", "token", "block")
    _write(rows, path, "postings", number, "folder")
    docs = placed.select("key", "length", F.array_join(F.array_distinct(_words("words")), " ").alias("tokens")).withColumn("folder", _folder(F.col("key"), folders))
    _write(docs.repartition("folder").sortWithinPartitions("folder", "key"), path, "documents", number, "folder")
    made = spark.read.schema(_POSTINGS).parquet(f"{path}/postings/segment={number}")
    blocks = made.select("block").distinct().count()
    more = made.select("token", F.col("docs").alias("n"))
    lost = {"docs": 0, "tokens": 0}
    gone = spark.createDataFrame([], "key long, gone_segment long")
    if old is not None:
        more = more.unionByName(old.select(F.explode("tokens").alias("token"), F.lit(-1).alias("n")))
        gone = old.select("key", F.col("segment").alias("gone_segment"))
        lost = old.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first().asDict()
    _write(gone, path, "gone", number)
    changed = more.groupBy("token").agg(F.sum("n").alias("df")).filter("df <> 0").withColumn("folder", _folder(F.col("token"), folders))
    _write(changed.repartition("folder").sortWithinPartitions("folder", "token"), path, "frequencies", number, "folder")
    line = [(number, batch, replaces, total["docs"] - lost["docs"], total["tokens"] - lost["tokens"], blocks, folders)]
    spark.createDataFrame(line, _LOG).coalesce(1).write.mode("overwrite").json(f"{path}/log/{number:012d}")


def _inverted(block: int):
    """From (key, words, length), ordered by length, the posting rows of blocks of that many documents."""

    def lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def posted(docs: pa.Table, number: int) -> pa.RecordBatch | None:
        docs = docs.filter(pc.greater(docs["length"], 0))
        if not docs.num_rows:
            return None
        key, length = docs["key"].to_numpy(), docs["length"].to_numpy()
        flat = pa.concat_arrays([c.flatten() for c in pc.split_pattern(docs["words"], " ").chunks]).dictionary_encode()
        doc = np.repeat(np.arange(len(length)), length)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
        ids = flat.indices.to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, doc, at = ids[order], doc[order], at[order]
        pair = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])])  # a token in a document
        tf, of, token = np.diff(np.r_[pair, len(ids)]), doc[pair], ids[pair]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        many = np.diff(np.r_[first, len(pair)])
        offsets = np.r_[first, len(pair)]
        columns = [
            flat.dictionary.take(pa.array(token[first])), pa.array(np.full(len(first), number, np.int64)), pa.array(np.maximum.reduceat(tf, first), pa.int32()), pa.array(np.minimum.reduceat(length[of], first), pa.int32()), pa.array(many, pa.int32()),
            lists(offsets, key[of], pa.int64()), lists(offsets, length[of], pa.int32()), lists(offsets, pair - np.repeat(pair[first], many), pa.int32()), lists(offsets, tf, pa.int32()), lists(np.r_[pair[first], len(ids)], at, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, left = TaskContext.get().partitionId() << _TASK_BITS, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            whole = t.num_rows - t.num_rows % block
            for i in range(0, whole, block):
                rows = posted(t.slice(i, block), number)
                number += 1
                if rows:
                    yield rows
            left = t.slice(whole)
        if left is not None and left.num_rows and (rows := posted(left, number)):
            yield rows

    return run


def size(spark: SparkSession, path: str) -> tuple[int, float]:
    """How many documents the index has, and the mean of their lengths."""
    of = segments(spark, path)
    docs = sum(s.docs for s in of)
    return docs, sum(s.tokens for s in of) / docs if docs else 0.0


def frequencies(spark: SparkSession, path: str, words: list[str]) -> dict[str, int]:
    """How many documents hold each word; a number per word reaches the driver."""
    rows = _of_words(spark, path, "frequencies", "token string, df long, folder int", words).groupBy("token").agg(F.sum("df").alias("df")).collect()
    return {w: 0 for w in words} | {r["token"]: r["df"] for r in rows}


def _of_words(spark: SparkSession, path: str, kind: str, schema: str, words: list[str]) -> DataFrame:
    """Rows of the words: the files of their folders, and of these the row groups that can hold them."""
    parts = [_part(spark, path, kind, schema, [s]).filter(F.col("folder").isin(*[_folder(F.lit(w), s.folders) for w in words]) & F.col("token").isin(*words)) for s in segments(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else _part(spark, path, kind, schema, [])


def _living(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """Without hits of documents that a later segment replaced."""
    gone = _part(spark, path, "gone", "key long, gone_segment long", segments(spark, path)).select("key", F.col("gone_segment").alias("segment"))
    return hits.join(gone, ["key", "segment"], "left_anti")


def live_postings(spark: SparkSession, path: str, words: list[str] | None = None) -> DataFrame:
    """(key, segment, block, token, length, positions) of the words, or of all tokens."""
    rows = _part(spark, path, "postings", _POSTINGS, segments(spark, path)) if words is None else _of_words(spark, path, "postings", _POSTINGS, words)
    return _living(spark, path, rows.select("token", "segment", "block", F.explode(_entries()).alias("_e")).select("token", "segment", "block", "_e.*"))


def any_word(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(key, token, tf, length) of the documents with any of the words."""
    return live_postings(spark, path, list(dict.fromkeys(words))).select("key", "token", F.size("positions").cast("long").alias("tf"), "length")


def phrase(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(key, tf, length) of the documents where the words follow one another. Blocks that lack a word are left out by their rows' first columns."""
    once = list(dict.fromkeys(words))
    rows = _of_words(spark, path, "postings", _POSTINGS, once)
    whole = rows.groupBy("segment", "block").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(once)).select("segment", "block")
    return _phrases(spark, path, rows.join(whole, ["segment", "block"]), words)


def _phrases(spark: SparkSession, path: str, rows: DataFrame, words: list[str]) -> DataFrame:
    each = rows.select("token", "segment", F.explode(_entries()).alias("_e")).select("token", "segment", "_e.*")
    own = [F.max(F.when(F.col("token") == w, F.col("positions"))).alias(f"_p{i}") for i, w in enumerate(dict.fromkeys(words))]
    met = each.groupBy("key", "segment", "length").agg(*own)
    column = {w: f"_p{i}" for i, w in enumerate(dict.fromkeys(words))}
    begins = [F.transform(column[w], _back(i)) for i, w in enumerate(words)]
    both = reduce(F.array_intersect, begins)  # null if a word is missing
    found = met.select("key", "segment", "length", F.coalesce(F.size(both), F.lit(0)).cast("long").alias("tf")).filter("tf > 0")
    return _living(spark, path, found).select("key", "tf", "length")


def _back(i: int):
    return lambda p: p - i


def idf(docs: int, df: int) -> float:
    odds = log((docs - df + 0.5) / (df + 0.5))
    return odds if odds > 0 else LEAST_IDF


def _score(weight: Column, tf: Column, length: Column, mean: float) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def _weights(spark: SparkSession, path: str, words: list[str]) -> tuple[dict[str, float], float]:
    docs, mean = size(spark, path)
    return {w: idf(docs, n) for w, n in frequencies(spark, path, words).items()}, mean


def _weight(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("token")]


def bm25(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """(key, rank) of all documents with any of the words; the lower the better."""
    words = list(dict.fromkeys(words))
    weights, mean = _weights(spark, path, words)
    hits = any_word(spark, path, words)
    return hits.groupBy("key").agg((-F.sum(_score(_weight(weights), F.col("tf"), F.col("length"), mean))).alias("rank"))


@dataclass
class Top:
    """The most relevant rows (key, rank), and how many blocks have any of the words and were read."""

    rows: DataFrame
    blocks: int
    read: int


def _first(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("rank", "key").limit(n)


def _pruned(bounds: DataFrame, score, n: int) -> Top:
    """``bounds``: (segment, block, bound), no document of a block scoring more. Blocks of the highest
    bounds are scored first, ``n`` of them; only blocks whose bound reaches the last place
    among these documents are scored then. ``score`` gives the (key, rank) of some blocks."""
    bounds = stored(bounds, "bounds")
    tried = bounds.orderBy(F.desc("bound"), "segment", "block").limit(n)
    place = [r["rank"] for r in _first(score(tried), n).select("rank").collect()]
    least = -place[-1] if len(place) == n else 0.0
    left = bounds.filter(F.col("bound") >= least - 1e-9 * (1 + abs(least)))  # rounding may put a sum a little below its bound
    blocks, read = bounds.count(), left.count()
    return Top(_first(score(left), n), blocks, read)


def top_words(spark: SparkSession, path: str, words: list[str], n: int) -> Top:
    """The n documents that ``bm25`` puts first, without scoring all: the bound of a block is the sum over its words of
    what the greatest count and the least length give."""
    words = list(dict.fromkeys(words))
    weights, mean = _weights(spark, path, words)
    rows = _of_words(spark, path, "postings", _POSTINGS, words)
    part = _score(_weight(weights), F.col("most_tf"), F.col("least_length"), mean)
    bounds = rows.select("segment", "block", part.alias("_b")).groupBy("segment", "block").agg(F.sum("_b").alias("bound"))

    def score(blocks: DataFrame) -> DataFrame:
        some = rows.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi").select("token", "segment", F.explode(_entries()).alias("_e")).select("token", "segment", "_e.*")
        hits = _living(spark, path, some)
        return hits.groupBy("key").agg((-F.sum(_score(_weight(weights), F.size("positions"), F.col("length"), mean))).alias("rank"))

    return _pruned(bounds, score, n)


def top_phrase(spark: SparkSession, path: str, words: list[str], n: int) -> Top:
    """The n documents most relevant to a phrase, which scores as one term. Its frequency needs the
    places in all blocks that have every word; scores are made in few of them. A phrase can't be
    more often in a document than its rarest word."""
    once = list(dict.fromkeys(words))
    docs, mean = size(spark, path)
    rows = _of_words(spark, path, "postings", _POSTINGS, once)
    weight = F.lit(idf(docs, phrase(spark, path, words).count()))
    whole = rows.groupBy("segment", "block").agg(F.count("*").alias("_n"), F.min("most_tf").alias("_tf"), F.max("least_length").alias("_length")).filter(F.col("_n") == len(once))
    bounds = whole.select("segment", "block", _score(weight, F.col("_tf"), F.col("_length"), mean).alias("bound"))

    def score(blocks: DataFrame) -> DataFrame:
        some = rows.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi")
        return _phrases(spark, path, some, words).select("key", (-_score(weight, F.col("tf"), F.col("length"), mean)).alias("rank"))

    return _pruned(bounds, score, n)
