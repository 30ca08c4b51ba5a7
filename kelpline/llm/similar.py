"""Near duplicates on five-word shingles, through the Gray-order index.

1. A text's shingles are hashed into 256 bins; the lowest bit of each bin's least hash makes a
   fingerprint of 256 bits. Fingerprints of texts of similarity s differ in (1 - s) / 2 of their
   bits, wherever the texts differ. Least hashes of 6 bins at a time make 21 bands.
2. Texts that share a band meet in a bucket. There the first 64 bits are sorted by Gray rank and
   searched as a hierarchy (``simhash.linked``), and all 256 bits decide on candidates.
3. Inside each component of candidates the exact sets of shingles decide on links.

At a similarity of 0.8 a pair shares a band with a probability of 1 - (1 - 0.8 ** 6) ** 21 = 0.998
and then stays below the differing bits allowed with one of 0.9997; above it both grow quickly.
A bucket or component that is too large for one task is cut into blocks. First all its rows meet
one leader; the rows that are unlike it then meet all others, a pair of blocks in a task, so
every pair that could still join two trees is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm import common
from kelpline.llm.simhash import ROWS, SEED, _union, in_buckets, linked
from kelpline.operators import graph

WORDS, SIMILARITY = 5, 0.8
#: Bins of a fingerprint; bands and bins (of half as many) of a band; bits that candidates may differ in, of the first 64 and of all.
BINS, BANDS, BAND, NEAR, APART = 256, 21, 6, 16, 44
#: Shingles of a component that one task compares.
SHINGLES = 1 << 21
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)]
_KNOWN = 300_000

Alike = Callable[[pa.RecordBatch], np.ndarray]


def _word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words, through a cache."""
    import xxhash

    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            if len(known) > _KNOWN:
                known.clear()
            h = known[w] = xxhash.xxh64_intdigest(w, SEED)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit hashes of the five-word shingles of at least one word; of fewer words, one of all."""
    h = _word_hashes(words, known)
    k = min(WORDS, len(h))
    mixed = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[0] + h[i : i + len(mixed)]
    return np.sort((mixed ^ (mixed >> np.uint64(32))) * _ODD[1])


def profile(text: bytes | None, known: dict[bytes, int]) -> tuple[bytes, int, list[int], bytes]:
    """Of a text: a 128-bit hash of its words in order (zero without words), how many distinct
    shingles it has, the bands that aren't empty, and its fingerprint."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return bytes(16), 0, [], bytes(BINS // 8)
    every = np.unique(shingles(words, known))
    at = (every >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    bits = np.zeros(BINS, np.uint8)
    bits[at[first]] = every[first] & np.uint64(1)
    half = np.zeros(BINS // 2, np.uint64)
    first = np.flatnonzero(np.diff(at >> 1, prepend=-1))
    half[at[first] >> 1] = every[first]
    half = half[: BANDS * BAND].reshape(BANDS, BAND)
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND):
        band = (band ^ (band >> np.uint64(29)) ^ half[:, i]) * _ODD[i % 2]
    return xxhash.xxh3_128_digest(b" ".join(words)), len(every), band[half.any(1)].view(np.int64).tolist(), np.packbits(bits).tobytes()


def _profiles(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [profile(t, known) for t in texts]
            md5 = [None if t is None else hashlib.md5(t).hexdigest() for t in texts]
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(md5, pa.string()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "text_md5", "key", "weight", "bands", "payload"])

    return common.mapped(docs.select("doc_id", "text"), run, "doc_id long, text_md5 string, key binary, weight long, bands array<long>, payload binary")


def _codes(payloads: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(payloads.to_pylist()), ">u8").astype(np.uint64).reshape(-1, BINS // 64)


def _near_codes(batch: pa.RecordBatch) -> np.ndarray:
    a, b = (_codes(batch.column(c)) for c in ("payload", "leader"))
    return np.bitwise_count(a ^ b).sum(1) <= APART


def _settle_codes(bucket: np.ndarray, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    code, node = _codes(rows.column("payload")), rows.column("node").to_numpy()
    same = lambda a, b: np.bitwise_count(code[a] ^ code[b]).sum(1) <= APART
    root = linked(bucket, code[:, 0].copy(), 64, NEAR, same, rows.column("known").to_numpy())
    own = root != np.arange(len(root))
    return node[own], node[root[own]]


def joined_sets(group: np.ndarray, sets: list[np.ndarray], known: np.ndarray, least: float) -> np.ndarray:
    """The least row that each row is connected to by links inside its group, a link being a
    similarity (Jaccard) of ``least`` or more of two sets. Groups come in order. Rows that
    ``known`` marks are connected from the start. Of each group, rows outside of its largest tree
    meet all others, one after another, until none is left that hasn't: so of two rows in
    different trees one has met the other."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    at, owner = np.cumsum(size) - size, np.repeat(np.arange(n), size)
    every = (np.concatenate(sets) if n else np.zeros(0, np.uint64)) + group[owner].astype(np.uint64) * _ODD[0]
    order = np.argsort(every, kind="stable")
    new = np.concatenate([[True], every[order][1:] != every[order][:-1]]) if len(every) else np.zeros(0, bool)
    ident = np.empty(len(every), np.int64)
    ident[order] = np.cumsum(new) - 1
    first, holders = np.flatnonzero(new), owner[order]
    times = np.diff(np.append(first, len(every)))
    label, met = np.arange(n), np.zeros(n, bool)
    marked = np.flatnonzero(known)
    if len(marked):
        heads = np.unique(group[marked], return_index=True)[1]
        label = _union(label, marked, np.repeat(marked[heads], np.diff(np.append(heads, len(marked)))))
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    within = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
    while n:
        rank = np.bincount(label, minlength=n)[label] * (n + 1) - label  # the largest tree, of equal ones the first
        outside = np.flatnonzero((rank != np.maximum.reduceat(rank, begins)[within]) & ~met)
        if not len(outside):
            break
        lead = outside[np.unique(within[outside], return_index=True)[1]]
        met[lead] = True
        ids = ident[np.repeat(at[lead], size[lead]) + common.ranges(size[lead])]
        rows = holders[np.repeat(first[ids], times[ids]) + common.ranges(times[ids])]
        shared = np.bincount(rows, minlength=n)  # a row meets the leader of its own group only
        other = np.flatnonzero(shared)
        mate = np.full(len(begins), -1)
        mate[within[lead]] = lead
        mate = mate[within[other]]
        alike = shared[other] >= least * (size[other] + size[mate] - shared[other]) - 1e-9
        label = _union(label, other[alike], mate[alike])
    return label


def _near_sets(least: float) -> Alike:
    def near(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, bool)
        for i, (a, b) in enumerate(zip(batch.column("payload").to_pylist(), batch.column("leader").to_pylist(), strict=True)):
            shared = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            out[i] = shared >= least * (len(a) // 8 + len(b) // 8 - shared) - 1e-9
        return out

    return near


def _settle_sets(least: float) -> Callable[[np.ndarray, pa.Table], tuple[np.ndarray, np.ndarray]]:
    def settle(bucket: np.ndarray, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("payload").to_pylist()]
        root = joined_sets(bucket, sets, rows.column("known").to_numpy(), least)
        node, own = rows.column("node").to_numpy(), root != np.arange(len(root))
        return node[own], node[root[own]]

    return settle


def _links(rows: DataFrame, alike: Alike, settle: Callable, most: int, by_weight: bool) -> DataFrame:
    """Edges (a, b) between nodes that connect them as all links inside their buckets would.
    ``rows``: bucket, size (the bucket's whole weight), weight, node and payload. Buckets up to
    ``most`` are settled each in a task."""
    columns = ["bucket", "node", "payload", "known", "weight"]
    few = rows.filter(F.col("size") <= most).withColumn("known", F.lit(False)).select(*columns)
    weight = "weight" if by_weight else None
    if rows.filter(F.col("size") > most).isEmpty():
        return in_buckets(few, settle, weight, most)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "node", "payload")), pa.array(alike(batch)), batch.column("weight"), batch.column("head")], names=[*columns, "head"])

    many = rows.filter(F.col("size") > most)
    lead = many.groupBy("bucket").agg(F.min_by(F.struct("node", "payload"), F.struct(F.xxhash64("node"), "node")).alias("l")).select("bucket", F.col("l.node").alias("head"), F.col("l.payload").alias("leader"))
    met = common.stored(common.mapped(many.join(lead, "bucket").select("bucket", "node", "payload", "weight", "head", "leader"), near, "bucket long, node long, payload binary, known boolean, weight long, head long"), "led")
    blocks = lambda w: F.ceil(F.coalesce(F.sum(w), F.lit(0)) / F.lit(max(1, most // 2))).cast("int")
    counts = met.groupBy("bucket").agg(blocks(F.col("weight")).alias("all"), blocks(F.when(~F.col("known"), F.col("weight"))).alias("left")).filter(F.col("left") > 0)
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    dealt = met.join(counts, "bucket")
    x = dealt.filter(~F.col("known")).withColumn("i", part("left")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    y = dealt.withColumn("j", part("all")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("left") - 1)))
    jobs = x.unionByName(y).withColumn("bucket", F.xxhash64("bucket", "i", "j")).select(*columns)
    led = met.filter("known and node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return in_buckets(few.unionByName(jobs), settle, weight, most).unionByName(led).filter("a <> b")


def _exact(docs: DataFrame, uniq: DataFrame, star: DataFrame, least: float, most: int) -> DataFrame:
    """Edges between nodes inside the components ``star`` of candidates, by the exact sets of shingles."""
    inside = star.select(F.col("u").alias("node"), F.col("v").alias("bucket")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("bucket")).distinct())
    inside = inside.join(uniq.select("node", "weight", F.col("head.doc_id").alias("_id"), F.col("head.text_md5").alias("_md5")), "node")
    sizes = inside.groupBy("bucket").agg(F.sum("weight").alias("size"))
    inside = inside.join(sizes, "bucket")
    texts = docs.select("doc_id", "text", F.md5("text").alias("text_md5"))
    found = texts.join(inside, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("text_md5") == F.col("_md5")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            payload = [np.unique(shingles(t.lower().split(), known)).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("bucket", "size", "weight", "node")), pa.array(payload, pa.binary())], names=["bucket", "size", "weight", "node", "payload"])

    rows = common.mapped(found.select("text", "bucket", "size", "weight", "node"), sets, "bucket long, size long, weight long, node long, payload binary")
    # a text that several rows of one doc_id repeat is one
    once = common.stored(rows.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("bucket", "size", "weight", "payload")]), "sets")
    return _links(once, _near_sets(least), _settle_sets(least), most, True)


def similar_documents(docs: DataFrame, least: float = SIMILARITY, rows: int = ROWS, most: int = SHINGLES) -> DataFrame:
    """A row for each doc_id and text of ``docs`` (doc_id, text): doc_id, text_md5, n (how many rows
    have both), component_id, and stays, which holds for one row of each component, that of the
    least doc_id and, within it, of the least text_md5. Documents are linked if their five-word
    shingles have a similarity (Jaccard) of ``least`` or more.

    Texts of the same words in order are one from the start, by a hash of 128 bits; null and
    wordless texts are alike. A null doc_id is a component_id only if its component has no other.
    ``rows`` and ``most`` bound what a task compares at a time, not what is compared. An empty
    table gives no rows; other columns are not looked at."""
    common.tune(docs.sparkSession)
    seen = common.stored(_profiles(docs), "profiles")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("head")
    uniq = seen.groupBy("key").agg(head, *[F.any_value(c).alias(c) for c in ("weight", "bands", "payload")])
    uniq = common.stored(uniq.withColumn("node", F.monotonically_increasing_id()), "distinct")
    met = uniq.select("node", F.explode("bands").alias("bucket"))
    shared = met.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    banded = met.join(shared, "bucket").join(uniq.select("node", "payload"), "node").withColumn("weight", F.lit(1).cast("long"))
    candidates = graph.components(_links(common.stored(banded, "buckets"), _near_codes, _settle_codes, rows, False))
    star = graph.components(_exact(docs, uniq, candidates, least, most))
    rooted = uniq.select("node", "key", "head").join(star.withColumnRenamed("u", "node"), "node", "left").select("key", "head", F.coalesce("v", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("head").alias("kept"))
    named = rooted.join(kept, "root").select("key", "kept")
    every = seen.groupBy("key", "doc_id", "text_md5").agg(F.count("*").alias("n")).join(named, "key")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & F.col("text_md5").eqNullSafe(F.col("kept.text_md5"))
    return every.select("doc_id", "text_md5", "n", F.col("kept.doc_id").alias("component_id"), stays.alias("stays"))
