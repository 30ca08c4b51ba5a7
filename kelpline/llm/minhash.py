"""Near duplicates on two-word shingles by one-permutation hashing.

1. One hash of each shingle deals a set into 256 bins; a bin's value is its least hash. An empty bin
   takes the value of the full bin that it prefers by a fixed hash of both bins (optimal
   densification), so that any two bins agree with the sets' similarity, however small they are.
2. Five bins make a band, 40 bands a text's buckets. At a similarity of 0.8 two sets share one with
   a probability of 1 - (1 - 0.8 ** 5) ** 40 = 0.9999999.
3. A bucket gives a star of candidate edges, from its least row to all others, so pairs grow with rows.
   An edge stands if the bins of both ends agree in 6 of 10. Only in buckets whose rows are not
   all connected by then, of all buckets, rows meet others than the centre (``similar._links``).
4. Inside each component of candidates the full sets decide, by stars again: rows outside of the
   largest tree meet all others, one after another, until none is left that hasn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import common
from kelpline.llm.similar import _ODD, SHINGLES, _links, _near_sets, _settle_sets, _word_hashes
from kelpline.llm.simhash import ROWS, linked
from kelpline.operators import graph

WORDS, SIMILARITY = 2, 0.8
#: Bins; bands and bins of a band; bins that must agree of all, and bits that may differ of 64.
BINS, BANDS, BAND, AGREE, NEAR = 256, 40, 5, 154, 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    return (x ^ (x >> np.uint64(27))) * _ODD[0] ^ (x >> np.uint64(31))


#: How much bin i (row) likes bin j (column): the full bin of the least number is taken.
_LIKES = _mixed(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * _ODD[0]).reshape(BINS, BINS)


def shingle_set(text: bytes | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the two-word shingles; of one word, of the word."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = _mixed(_word_hashes(words, known))
    return np.unique(_mixed(h[:-1] * _ODD[0] + h[1:]) if len(h) > 1 else h)


def bins_of(every: np.ndarray) -> np.ndarray:
    """The densified bins of a set that isn't empty."""
    at = (every >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    full = at[first]
    source = np.arange(BINS)
    empty = np.setdiff1d(source, full, assume_unique=True)
    source[empty] = full[_LIKES[np.ix_(empty, full)].argmin(1)]
    value = np.zeros(BINS, np.uint64)
    value[full] = every[first]
    return value[source]


def bands_of(bins: np.ndarray) -> np.ndarray:
    """Hashes of the bands, each with its number."""
    rows = bins[: BANDS * BAND].reshape(BANDS, BAND)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND):
        out = _mixed(out + rows[:, i])
    return out.view(np.int64)


def _profiles(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known: dict[bytes, int] = {}
        for batch in batches:
            keys, sizes, bands, sketches = [], [], [], []
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                every = shingle_set(t, known)
                bins = bins_of(every) if len(every) else np.zeros(0, np.uint64)
                keys.append(xxhash.xxh3_128_digest(every.tobytes()) if len(every) else bytes(16))
                sizes.append(len(every))
                bands.append(bands_of(bins) if len(every) else np.zeros(0, np.int64))
                sketches.append(bins.astype(np.uint8).tobytes())
            ends = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array(sketches, pa.binary())], names=["doc_id", "mark", "key", "weight", "bands", "payload"])

    marked = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    return common.mapped(marked, run, "doc_id long, mark long, key binary, weight long, bands array<long>, payload binary")


def _sketches(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _near(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (_sketches(batch.column(c)) for c in ("payload", "leader"))
    return (a == b).sum(1) >= AGREE


def _settle(bucket: np.ndarray, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sketch, node = _sketches(rows.column("payload")), rows.column("node").to_numpy()
    code = np.packbits(sketch[:, :64] & 1, axis=1).view(">u8").ravel().astype(np.uint64)
    same = lambda a, b: (sketch[a] == sketch[b]).sum(1) >= AGREE
    root = linked(bucket, code, 64, NEAR, same, rows.column("known").to_numpy())
    own = root != np.arange(len(root))
    return node[own], node[root[own]]


def star_edges(met: DataFrame, uniq: DataFrame) -> DataFrame:
    """Edges (a, b) from the rows of each bucket (bucket, node) to its least, where bins agree. A
    pair that several buckets give is compared once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_near(batch))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    centre = met.groupBy("bucket").agg(F.min("node").alias("b"))
    edges = met.join(centre, "bucket").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    sketch = lambda key, name: uniq.select(F.col("node").alias(key), F.col("payload").alias(name))
    return common.mapped(edges.join(sketch("a", "payload"), "a").join(sketch("b", "leader"), "b").select("a", "b", "payload", "leader"), run, "a long, b long")


def candidates(uniq: DataFrame, rows: int = ROWS) -> DataFrame:
    """The components (u, v) of all sets (node, bands, payload) that share a bucket and agree in their bins."""
    met = uniq.select("node", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    met = common.stored(met.join(shared, "bucket"), "buckets")
    edges = common.stored(star_edges(met, uniq), "stars")
    star = graph.components(edges)
    placed = met.join(star.withColumnRenamed("u", "node"), "node", "left").withColumn("v", F.coalesce("v", "node"))
    apart = placed.groupBy("bucket").agg(F.min("v").alias("least"), F.max("v").alias("most")).filter("least <> most").select("bucket")
    rest = common.stored(met.join(apart, "bucket").join(uniq.select("node", "payload"), "node").withColumn("weight", F.lit(1).cast("long")), "apart")
    return graph.components(star.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(_links(rest, _near, _settle, rows, False)))


def _confirmed(docs: DataFrame, uniq: DataFrame, star: DataFrame, least: float, most: int) -> DataFrame:
    """Edges between sets inside the components ``star`` of candidates, by the full sets."""
    inside = star.select(F.col("u").alias("node"), F.col("v").alias("bucket")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("bucket")).distinct())
    inside = inside.join(uniq.select("node", "weight", "key", F.col("head.doc_id").alias("_id"), F.col("head.mark").alias("_mark")), "node")
    sizes = inside.groupBy("bucket").agg(F.sum("weight").alias("size"))
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    found = texts.join(inside.join(sizes, "bucket"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            payload = [shingle_set(t, known).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "size", "weight", "node")), pa.array(payload, pa.binary())], names=["bucket", "size", "weight", "node", "payload"])

    rows = common.mapped(found.select("text", "bucket", "size", "weight", "node"), sets, "bucket long, size long, weight long, node long, payload binary")
    once = common.stored(rows.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("bucket", "size", "weight", "payload")]), "sets")
    return _links(once, _near_sets(least), _settle_sets(least), most, True)


def minhash_near_duplicates(docs: DataFrame, least: float = SIMILARITY, rows: int = ROWS, most: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    A text's set are its distinct two-word shingles, A-Z in lower case; of one word, the word. Sets of
    a similarity (Jaccard) of ``least`` or more are linked; component_id is the least doc_id that
    links reach, kept holds where it is the row's own. Null and wordless texts have no shingles and
    stay by themselves. Rows of equal sets are one from the start, by a hash of 128 bits, so
    repeated rows are linked. A null doc_id is a component_id only if its component has no other.
    Long texts are sets like others. ``rows`` and ``most`` bound what a task compares at a time,
    not what is compared. An empty table gives no rows; other columns are not looked at."""
    common.tune(docs.sparkSession)
    seen = common.stored(_profiles(docs), "profiles")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("head")
    uniq = seen.filter("weight > 0").groupBy("key").agg(head, *[F.any_value(c).alias(c) for c in ("weight", "bands", "payload")])
    uniq = common.stored(uniq.withColumn("node", F.monotonically_increasing_id()), "distinct")
    star = graph.components(_confirmed(docs, uniq, candidates(uniq, rows), least, most))
    rooted = uniq.select("node", "key", "head").join(star.withColumnRenamed("u", "node"), "node", "left").select("key", "head", F.coalesce("v", "node").alias("root"))
    reached = rooted.groupBy("root").agg(F.min("head").alias("first"))
    named = rooted.join(reached, "root").select("key", F.col("first.doc_id").alias("component_id"))
    linked_rows = seen.filter("weight > 0").select("doc_id", "key", F.col("weight").alias("n_shingles")).join(named, "key").drop("key")
    alone = seen.filter("weight = 0").select("doc_id", F.col("weight").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_duplicates(common.documents(spark, sf_dir))
