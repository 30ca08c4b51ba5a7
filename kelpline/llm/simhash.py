"""SimHash near-duplicates through a Gray-order hierarchical index.

Two fingerprints that differ in at most ``most`` bits agree wholly in one of
``most + 1`` blocks of bits. Each distinct fingerprint therefore goes to one bucket
per block. Inside a bucket the fingerprints, with the block's bits left out, are
sorted by Gray rank; runs that share leading bits are the nodes of a tree. Pairs of
nodes are searched from the root down, and a pair of whole groups is given up as soon
as the bits of its shared patterns differ too often. A bucket that holds many
fingerprints is split by blocks of its remaining bits first, by the same argument.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import common
from kelpline.operators import graph

SEED, SHINGLE, MOST = 42, 3, 2
#: Bits of a tree level; node pairs opened at a time; fingerprints a bucket may hold before it is split.
_DIGIT, _OPEN, SPLIT = 6, 1 << 21, 2_000
#: Pairs of rows that are compared at a time, before those that are in one tree by then are left out; rows of a bucket that meet all first.
_MEET, _LEADERS = 1 << 17, 3
#: Rows that a task works on at a time: whole buckets, as many as make up so many rows.
ROWS = 1 << 16


def fingerprint(text: bytes | None, words: int = SHINGLE, seed: int = SEED) -> bytes:
    """Eight bytes, the highest bit first; a null or wordless text gives zero."""
    import xxhash

    ws = text.lower().split() if text else []
    if not ws:
        return bytes(8)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    k = min(words, len(ws))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ws) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    n, count = len(bits), np.zeros(64, np.int64)
    for at in range(0, n, 255):
        count += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * count > n).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join(map(fingerprint, batch.column(1).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    return common.mapped(docs.select("doc_id", "text"), run, "doc_id long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code word (uint64) in the reflected Gray sequence."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _roots(label: np.ndarray) -> np.ndarray:
    while not np.array_equal(label, up := label[label]):
        label = up
    return label


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the trees of linked rows; every label stays the least row of its tree."""
    while True:
        x, y = label[a], label[b]
        keep = x != y
        if not keep.any():
            return label
        a, b = a[keep], b[keep]
        np.minimum.at(label, np.maximum(x, y)[keep], np.minimum(x, y)[keep])
        label = _roots(label)


def _absorbed(bucket: np.ndarray, code: np.ndarray, most: int, same: Callable[[np.ndarray, np.ndarray], np.ndarray], label: np.ndarray) -> np.ndarray:
    """Labels after some rows of each bucket have met all its others: this joins the bulk of a
    family at the cost of a few rows. Links of the other rows are left to the search."""
    n = len(bucket)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    apart = np.ones(n, bool)
    for _ in range(_LEADERS):
        # of each bucket's rows that met no leader yet the first leads
        left = np.flatnonzero(apart & np.repeat(size > 2, size))
        if not len(left):
            break
        lead = left[np.unique(bucket[left], return_index=True)[1]]
        own = np.searchsorted(first, lead, "right") - 1
        lead, other = np.repeat(lead, size[own]), np.repeat(first[own], size[own]) + common.ranges(size[own])
        some = (label[other] != label[lead]) & (np.bitwise_count(code[lead] ^ code[other]) <= most)
        lead_, other_ = lead[some], other[some]
        alike = same(lead_, other_)
        label = _union(label, lead_[alike], other_[alike])
        apart[other[label[other] == label[lead]]] = False
        apart[lead] = False
    return label


def linked(
    bucket: np.ndarray, code: np.ndarray, n_bits: int, most: int = MOST, same: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, known: np.ndarray | None = None
) -> np.ndarray:
    """For rows of (bucket, code), codes being left-aligned uint64 of ``n_bits`` bits, the
    least row that each is connected to by links of at most ``most`` differing bits
    inside its bucket. With ``same`` (of two arrays of rows), only pairs that it holds for
    are links. Rows that ``known`` marks are connected in their bucket from the start."""
    n = len(code)
    order = np.lexsort((gray_rank(code), bucket))
    bucket, code = bucket[order], code[order]
    if same:
        alike = lambda a, b: same(order[a], order[b])
        label = np.arange(n)
        if known is not None:
            marked = np.flatnonzero(known[order])
            heads = np.unique(bucket[marked], return_index=True)[1]
            label = _union(label, marked, np.repeat(marked[heads], np.diff(np.append(heads, len(marked)))))
        label = _search(bucket, code, n_bits, most, alike, _absorbed(bucket, code, most, alike, label))
    else:
        label = _search(bucket, code, n_bits, most, None)
    out = np.arange(n)
    least = np.full(n, n)
    np.minimum.at(least, label, order)
    out[order] = least[label]
    return out


def _meet(label: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The labels after all rows of node ``a[i]`` have met all rows of node ``b[i]``, but for pairs
    that are in one tree already. Nodes are runs of ``size`` rows from ``first``."""
    if len(a):
        low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
        open_ = np.flatnonzero((low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b]))
        a, b = a[open_], b[open_]
    each = size[a] * size[b]

    def meet(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal label
        apart = np.flatnonzero(label[x] != label[y])
        x, y = x[apart], y[apart]
        alike = same(x, y)
        label = _union(label, x[alike], y[alike])

    few = np.flatnonzero(each <= _MEET)
    for s, e in common.slices(each[few].tolist(), _MEET):
        at = few[s:e]
        k, pair = common.ranges(each[at]), np.repeat(at, each[at])
        meet(first[a[pair]] + k // size[b[pair]], first[b[pair]] + k % size[b[pair]])
    for i in np.flatnonzero(each > _MEET).tolist():
        x, y = (first[c[i]] + np.arange(size[c[i]]) for c in (a, b))
        # rows of the largest tree don't meet each other
        of, count = np.unique(np.append(label[x], label[y]), return_counts=True)
        top = of[count.argmax()]
        sides = [(x[label[x] != top], y), (y[label[y] != top], x[label[x] == top])]
        for one, other in sides if a[i] != b[i] else sides[:1]:
            step = max(1, _MEET // max(1, len(other)))
            for s in range(0, len(one), step):
                part = one[s : s + step]
                meet(np.repeat(part, len(other)), np.tile(other, len(part)))
    return label


def _search(
    bucket: np.ndarray, code: np.ndarray, n_bits: int, most: int, same: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, label: np.ndarray | None = None
) -> np.ndarray:
    """Of sorted rows, the first row of the tree of links that each is in; ``label`` has the trees known before."""
    n = len(code)
    # nodes by level: first row of each run that shares the bucket and the leading bits
    depth = [0, *range(_DIGIT, n_bits, _DIGIT), n_bits]
    starts = []
    for d in depth:
        top = code >> np.uint64(64 - d) if d else np.zeros(n, np.uint64)
        starts.append(np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (top[1:] != top[:-1])])) if n else np.zeros(0, np.int64))
    label = np.arange(n) if label is None else label
    roots = np.flatnonzero(np.diff(np.append(starts[0], n)) > 1)
    work = [(0, roots, roots)]
    while work:
        level, a, b = work.pop()
        if not len(a):
            continue
        if level == len(depth) - 1:
            if same:
                label = _meet(label, starts[level], np.diff(np.append(starts[level], n)), a, b, same)
            else:
                label = _union(label, starts[level][a], starts[level][b])
            continue
        if same and n:  # nodes whose rows are all in one tree need not meet
            low, high = np.minimum.reduceat(label, starts[level]), np.maximum.reduceat(label, starts[level])
            open_ = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
            a, b = a[open_], b[open_]
            if not len(a):
                continue
        first = np.searchsorted(starts[level + 1], starts[level])
        size = np.diff(np.append(first, len(starts[level + 1])))
        each = size[a] * size[b]
        if len(a) > 1 and each.sum() > _OPEN:
            half = len(a) // 2
            work += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
            continue
        k = common.ranges(each)
        pair = np.repeat(np.arange(len(a)), each)
        x, y = first[a[pair]] + k // size[b[pair]], first[b[pair]] + k % size[b[pair]]
        keep = x <= y
        x, y = x[keep], y[keep]
        shared = np.uint64(64 - depth[level + 1])
        apart = np.bitwise_count((code[starts[level + 1][x]] ^ code[starts[level + 1][y]]) >> shared)
        alone = x == y
        if same or level + 1 < len(depth) - 1:
            alone &= np.diff(np.append(starts[level + 1], n))[x] == 1  # one row meets only itself
        keep = (apart <= most) & ~alone
        work.append((level + 1, x[keep], y[keep]))
    if same:
        return label
    return _roots(label)[np.repeat(starts[-1], np.diff(np.append(starts[-1], n)))]  # equal codes follow their first row


def _turned(fp: F.Column, start: int, bits: int) -> tuple[F.Column, F.Column]:
    """The block's bits as a number, and all bits with the block turned to the front."""
    turned = fp if not start else F.shiftleft(fp, start).bitwiseOR(F.shiftrightunsigned(fp, 64 - start))
    return F.shiftrightunsigned(turned, 64 - bits), turned


def in_buckets(rows: DataFrame, settle: Callable[[np.ndarray, pa.Table], tuple[np.ndarray, np.ndarray]], weight: str | None = None, most: int = ROWS) -> DataFrame:
    """Edges (a, b) by ``settle`` (of the number of each row's bucket and the rows). Rows are dealt by
    ``bucket`` and come sorted by it; a task works on some whole buckets at a time, of about
    ``most`` rows or of so much ``weight``, so what it holds doesn't grow with the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def edges() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            key = table.column("bucket").to_numpy()
            a, b = settle(np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])), table)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            at = 0
            if size >= most and batch.num_rows:
                key = batch.column("bucket").to_numpy()
                other = np.flatnonzero(key != held[-1].column("bucket")[-1].as_py())
                at = int(other[0]) if len(other) else len(key)
                if at:
                    held.append(batch.slice(0, at))
                if len(other):
                    yield edges()
                    held, size = [], 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size += pc.sum(held[-1].column(weight)).as_py() if weight else held[-1].num_rows
        if held:
            yield edges()

    return common.mapped(rows.repartition(common.width(rows.sparkSession), "bucket").sortWithinPartitions("bucket"), run, "a long, b long")


def link_forest(uniq: DataFrame, most: int = MOST, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` of ``uniq`` exactly as
    all links would; at most one edge for a fingerprint and bucket."""
    cuts = [round(i * 64 / (most + 1)) for i in range(most + 2)]

    def edges(start: int, end: int) -> DataFrame:
        bits, rest = end - start, 64 - (end - start)
        key, turned = _turned(F.col("fp"), start, bits)
        keyed = uniq.select("fp", key.alias("key"), turned.alias("turned"))
        # crowded buckets go on to blocks of the bits that are left. Of a block's at most 2 ** 22 keys one in `split` rows is crowded
        crowd = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("key", F.lit(True).alias("crowded"))
        inner = [round(i * rest / (most + 1)) for i in range(most + 2)]
        finer = F.array(*[F.xxhash64("key", F.lit(i), F.shiftrightunsigned(F.shiftleft("turned", bits + a), 64 - (b - a))) for i, (a, b) in enumerate(zip(inner, inner[1:], strict=False))])
        buckets = F.when(F.col("crowded"), finer).otherwise(F.array(F.xxhash64("key")))

        def settle(bucket: np.ndarray, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            fp, code = (rows.column(c).to_numpy() for c in ("fp", "turned"))
            root = linked(bucket, code.view(np.uint64) << np.uint64(64 - rest), rest, most)
            own = root != np.arange(len(root))
            return fp[own], fp[root[own]]

        return in_buckets(keyed.join(F.broadcast(crowd), "key", "left").select("fp", "turned", F.explode(buckets).alias("bucket")), settle)

    return reduce(DataFrame.unionByName, [edges(a, b) for a, b in zip(cuts, cuts[1:], strict=False)])


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``
    (doc_id, text): the least doc_id that is reachable by links of at most ``most``
    differing bits.

    Null and empty texts have fingerprint zero and are linked like others. Repeated rows
    and repeated doc_ids keep their rows. A null doc_id is never a component_id unless
    its component has no other. An empty table gives no rows; other columns are not
    looked at."""
    common.tune(docs.sparkSession)
    fps = common.stored(fingerprints(docs), "fingerprints")
    uniq = common.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    star = graph.components(link_forest(uniq, most))
    rooted = uniq.join(star.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
