"""Token-id shards with a minimal perfect hash index.

A shard file holds a run of documents in ascending doc_id order::

    magic "KLPTOK01", then eleven u64: shard, documents, ids, bytes of an id (2 or 4),
    keys, null doc_ids, hash levels, seed, leftover keys, bytes of index, bytes of header
    index:  per level its size and its first bit (u64 each); the bits of all levels (u64 words)
            leftover keys with their slots (i64, u64)
            per key: fingerprint (u32), first document (u32)
    starts: documents + 1 offsets of the payload, in ids (u64)
    ids:    raw little-endian ids, u16 if the vocabulary allows it, else u32

A key is hashed through a cascade of bit arrays: at each level the keys that are alone
at their bit stay, the others go on. A key's slot is the number of bits set before its
own; its stored fingerprint tells absent keys from present ones. Looking up a document
thus takes constant time, then one slice of the payload.

Files are opened with ``pyarrow.fs`` (local and shared folders, HDFS, object stores),
written under a name of the attempt and renamed, so that a repeated task replaces the
file with an equal one.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.llm import common, tokens

END_ID = 1
#: Documents of a range, which one task writes, and ids of a shard, as a task holds no more of them (but for a longer document).
DOCS_PER_SHARD, IDS_PER_SHARD = 4096, 8 << 20
MAGIC, _GAMMA, _LEVELS = b"KLPTOK01", 2, 24


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    """Mixed 64-bit hash of int64 keys (the finaliser of splitmix64)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 for n distinct int64 keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, left: np.ndarray, left_slots: np.ndarray):
        self.sizes, self.bits, self.left, self.left_slots = sizes, bits, left, left_slots
        self.begins = np.cumsum(sizes) - sizes
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, seed: int) -> "PerfectHash":
        sizes, levels = [], []
        while len(keys) and len(sizes) < _LEVELS:
            size = -(-_GAMMA * len(keys) // 64) * 64
            at = (_hash(keys, seed + len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            keys = keys[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        left = np.sort(keys)
        return cls(np.array(sizes, np.int64), bits, left, int(np.bitwise_count(bits).sum()) + np.arange(len(left)))

    def slots(self, keys: np.ndarray, seed: int) -> np.ndarray:
        """-1 where a key surely is none of the set; other absent keys get any slot."""
        out, live = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = (_hash(keys[live], seed + level) % np.uint64(size)).astype(np.int64) + self.begins[level]
            word, bit = self.bits[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            found = (word & bit) != 0
            out[live[found]] = self.before[at[found] >> 6] + np.bitwise_count(word[found] & (bit[found] - np.uint64(1)))
            live = live[~found]
        if len(self.left) and len(live):
            i = np.minimum(np.searchsorted(self.left, keys[live]), len(self.left) - 1)
            hit = self.left[i] == keys[live]
            out[live[hit]] = self.left_slots[i[hit]]
        return out


def _fingerprints(keys: np.ndarray, seed: int) -> np.ndarray:
    return (_hash(keys, seed + 1009) >> np.uint64(32)).astype(np.uint32)


def pack_shard(shard: int, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, id_bytes: int, seed: int = 1) -> bytes:
    """The bytes of a shard file. doc_ids ascend, nulls first; a repeated doc_id names its first document in the shard."""
    nulls = sum(d is None for d in doc_ids)
    keys, first = np.unique(np.array(doc_ids[nulls:], np.int64), return_index=True)
    index = PerfectHash.build(keys, seed)
    table = np.zeros(len(keys), [("fingerprint", "<u4"), ("document", "<u4")])
    slot = index.slots(keys, seed)
    table["fingerprint"][slot], table["document"][slot] = _fingerprints(keys, seed), first + nulls
    body = b"".join([
        np.stack([index.sizes, index.begins], 1).astype("<u8").tobytes(), index.bits.astype("<u8").tobytes(),
        index.left.astype("<i8").tobytes(), index.left_slots.astype("<u8").tobytes(), table.tobytes(),
    ])
    head = np.array([shard, len(doc_ids), len(ids), id_bytes, len(keys), nulls, len(index.sizes), seed, len(index.left), len(body), 8 + 11 * 8], "<u8")
    return MAGIC + head.tobytes() + body + np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes() + ids.astype(f"<u{id_bytes}").tobytes()


class Shard:
    """A shard file's documents by key and by place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.shard, self.n_docs, self.n_ids, width, n_keys, self.nulls, levels, self.seed, left, size, at = np.frombuffer(data, "<u8", 11, 8).astype(np.int64).tolist()
        end = at + size

        def read(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        sizes = read("<u8", 2 * levels).astype(np.int64)[::2]
        self.index = PerfectHash(sizes, read("<u8", int(sizes.sum()) // 64), read("<i8", left), read("<u8", left).astype(np.int64))
        self.table = read([("fingerprint", "<u4"), ("document", "<u4")], n_keys)
        if at != end:
            raise ValueError("broken token shard")
        self.starts = read("<u8", self.n_docs + 1).astype(np.int64)
        self.ids = read(f"<u{width}", self.n_ids)

    def documents(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, -1 for absent keys (but for one in 2^32 that a fingerprint takes in)."""
        slot = self.index.slots(keys, self.seed)
        ok = (slot >= 0) & (slot < len(self.table))
        ok[ok] = self.table["fingerprint"][slot[ok]] == _fingerprints(keys[ok], self.seed)
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.table["document"][slot[ok]]
        return out

    def ids_at(self, document: int) -> np.ndarray:
        return self.ids[self.starts[document] : self.starts[document + 1]].astype("<u4")


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, docs_per_shard: int = DOCS_PER_SHARD, ids_per_shard: int = IDS_PER_SHARD) -> DataFrame:
    """Write the documents (doc_id, text) as shards into ``path`` and give the manifest, which
    is kept beside them: shard, file, n_docs, n_ids and doc_ids (as written). A range of long
    documents, or of a doc_id that very many rows share, makes several shards."""
    spark = docs.sparkSession
    common.tune(spark)
    tokenizer = tokenizer or tokens.default_tokenizer()
    n = max(1, -(-docs.select("doc_id").count() // docs_per_shard))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        id_bytes = 2 if max(len(enc.ends), end_id + 1) <= 1 << 16 else 4
        files, root = common.filesystem(path)
        at, held, doc_ids, parts, lengths = None, 0, [], [], []

        def written() -> pa.RecordBatch:
            nonlocal at, held, doc_ids, parts, lengths
            ids = np.concatenate(parts)
            data = pack_shard(at, doc_ids, ids, np.concatenate(lengths), id_bytes)
            name = f"shard-{at:012d}.tok"
            files.create_dir(root, recursive=True)
            attempt = f"{root}/.{name}.{uuid.uuid4().hex}"
            with files.open_output_stream(attempt) as out:
                out.write(data)
            files.move(attempt, f"{root}/{name}")
            row = ((at, pa.int64()), (name, pa.string()), (len(doc_ids), pa.int64()), (len(ids), pa.int64()), (doc_ids, pa.list_(pa.int64())))
            at, held, doc_ids, parts, lengths = at + 1, 0, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], names=["shard", "file", "n_docs", "n_ids", "doc_ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0)[0].as_py() << 20 if at is None else at
            keys, texts = batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in common.slices([len(t or b"") for t in texts], 4 << 20):
                ids, counts = enc.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(f"<u{id_bytes}")
                ends = np.cumsum(counts + 1)
                for s, e in common.slices((counts + 1).tolist(), ids_per_shard):
                    if held and held + int(ends[e - 1] - (ends[s - 1] if s else 0)) > ids_per_shard:
                        yield written()
                    doc_ids += keys[a + s : a + e]
                    parts.append(ids[ends[s - 1] if s else 0 : ends[e - 1]])
                    lengths.append(counts[s:e] + 1)
                    held += len(parts[-1])
        enc.forget()
        if doc_ids:
            yield written()

    common.mapped(ordered, run, "shard long, file string, n_docs long, n_ids long, doc_ids array<long>").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """Every document of the shards, looked up by its key: doc_id, start (ids before it in
    the whole order), n_tokens and ids_crc32 (of its ids as little-endian u32)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one short row per shard
    begins = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("begin"))
    plan = manifest.select("shard", "file", "doc_ids").join(begins, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = common.filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(f"{root}/{row['file']}") as f:
                    shard = Shard(f.read())
                doc_ids = row["doc_ids"]
                at = np.arange(shard.nulls)
                keys, first = np.unique(np.array(doc_ids[shard.nulls :], np.int64), return_index=True)
                found = shard.documents(keys)
                if (found < 0).any():
                    raise ValueError(f"{row['file']}: a document is missing")
                times = np.diff(np.append(first, len(doc_ids) - shard.nulls))
                at = np.concatenate([at, np.repeat(found, times) + common.ranges(times)]).astype(np.int64)
                crc = [zlib.crc32(shard.ids_at(i)) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(row["begin"] + shard.starts[at]), pa.array(shard.starts[at + 1] - shard.starts[at]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return common.mapped(plan, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, docs_per_shard: int = DOCS_PER_SHARD, ids_per_shard: int = IDS_PER_SHARD) -> DataFrame:
    """Write and read back. Null and empty texts hold the end id alone. Null doc_ids come
    first and repeated doc_ids follow one another, by text; all keep their rows. An empty
    table writes no shard and gives no rows. Other columns are not looked at. A task holds the
    ids of one shard, and a document longer than that by itself."""
    path = path or common.scratch_path(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, path, tokenizer, end_id, docs_per_shard, ids_per_shard), path)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(common.documents(spark, sf_dir))
