"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a run of documents of a few megabytes. Words that no benchmark text holds
can't be in a match, so they and the ends of documents become separators, and runs
too short for any window are left out; nothing else is. Over the rest a suffix array
is sorted, its Burrows-Wheeler transform goes into a wavelet matrix, and all windows
of the benchmark are searched backward at once by rank queries. Occurrences are located
by walking to sampled suffix positions. Spans of hit words are merged for removal.

A benchmark of up to a block's size goes to the executors with the job. A larger one is written in
blocks into the shared folder; a task reads one block after another for each of its shards, so
the documents are read once, whatever the benchmark's size, and nothing but hits is carried on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpline.llm import common

WINDOW = 10
#: Bytes of benchmark text that go to the executors at once; bytes of documents in a shard; distance of sampled suffixes.
BLOCK_BYTES, SHARD_BYTES, SAMPLE = 1 << 20, 8 << 20, 8

_LETTERS = bytes(range(ord("a"), ord("z") + 1)) + b"0123456789" + bytes(range(128, 256))
_TABLE = bytes((c | 32 if 65 <= c <= 90 else c if c in _LETTERS else 32) for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class WaveletMatrix:
    """Rank queries over numbers: one row of bits for each bit of the numbers, the highest first."""

    def __init__(self, values: np.ndarray, n_bits: int):
        self.rows = []
        for bit in range(n_bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.rows.append((packed, before, len(values) - int(ones.sum()), bit))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def _ones(row: tuple, at: np.ndarray) -> np.ndarray:
        packed, before, *_ = row
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(packed[at >> 6] & mask)

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each value is among the first ``at`` numbers."""
        begin, end = np.zeros_like(at), at
        for row in self.rows:
            zeros, bit = row[2], row[3]
            b, e, one = self._ones(row, begin), self._ones(row, end), (value >> bit & 1).astype(bool)
            begin, end = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, end - e)
        return end - begin


class FMIndex:
    """Over a sequence of numbers from 1; 0 separates and is in no pattern."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        n = self.n = len(seq)
        gap = seq == 0
        rank = np.where(gap, np.cumsum(gap) - 1, seq + gap.sum())  # each separator is a symbol of its own
        order, step = np.argsort(rank, kind="stable"), 1
        rank = self._dense(rank[order], order)
        while n and rank.max() < n - 1:  # prefix doubling; a separator ends every comparison
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            rank, step = self._dense(key[order], order), 2 * step
        sigma = int(seq.max()) + 1 if n else 1
        self.bwt = np.where(order > 0, seq[order - 1], 0) if n else seq
        self.tree = WaveletMatrix(self.bwt, max(1, int(sigma).bit_length()))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        # positions after a separator are sampled too, so that no walk steps over one
        kept = (order % sample == 0) | (self.bwt == 0)
        self.kept, self.place, self.position = kept, np.cumsum(kept) - 1, order[kept]

    @staticmethod
    def _dense(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else keys
        return rank

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each pattern (a row, padded at its end)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1 if len(patterns) else 1):
            live = live[(low[live] < high[live]) & (lengths[live] >= back)]
            symbol = patterns[live, lengths[live] - back]
            known = symbol < len(self.less) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = (self.less[symbol] + self.tree.rank(symbol, x[live]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        steps, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live):
            done = self.kept[rows[live]]
            ended = live[done]
            out[ended] = self.position[self.place[rows[ended]]] + steps[ended]
            live = live[~done]
            symbol = self.bwt[rows[live]]
            rows[live] = self.less[symbol] + self.tree.rank(symbol, rows[live])
            steps[live] += 1
        return out


class Block(NamedTuple):
    """Windows of some benchmark items: a word's number, the windows as numbers, and the items of each."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[list[str]]


def block_of(items: list[tuple[object, bytes | None]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item_id, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            found.setdefault(tuple(ids[i : i + window]), set()).add("" if item_id is None else str(item_id))
    patterns = np.zeros((len(found), window), np.int64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    for i, p in enumerate(found):
        patterns[i, : len(p)] = p
    return Block(vocabulary, patterns, lengths, [sorted(x) for x in found.values()])


def blocks(benchmark: DataFrame, window: int, most: int) -> list[Block | str]:
    """The benchmark (item_id, text) as one block, or as the files that hold one each. The driver
    holds ``most`` bytes of it at most, or the names of the files."""
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= most:
        return [block_of([(r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in rows.filter("text is not null").collect()], window)]
    path = common.scratch_path(benchmark.sparkSession, "benchmark")
    rows.repartition(-(-size // most)).write.parquet(path)
    return sorted(benchmark.sparkSession.read.parquet(path).inputFiles())


def _loaded(part: Block | str, window: int) -> Block:
    if isinstance(part, Block):
        return part
    from pyarrow import parquet

    files, path = common.filesystem(part)
    table = parquet.read_table(path, filesystem=files)
    return block_of(list(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist(), strict=True)), window)


def scan(texts: list[list[bytes]], block: Block) -> tuple[dict[int, np.ndarray], dict[int, set[str]]]:
    """Of a shard (the words of each text): of texts with hits the hit word numbers and the items."""
    get = block.vocabulary.get
    if not len(block.lengths) or not texts:
        return {}, {}
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    seq = np.zeros(int(counts.sum()) + len(texts), np.int64)  # documents don't run on
    ends = np.cumsum(counts + 1)
    for ws, end in zip(texts, ends.tolist(), strict=True):
        seq[end - 1 - len(ws) : end - 1] = np.fromiter([get(w, 0) for w in ws], np.int64, len(ws))
    least = int(block.lengths.min())
    # runs between separators; short ones can hold no window
    gap = seq == 0
    edge = np.flatnonzero(gap)
    run = np.diff(np.concatenate([[-1], edge])) - 1
    keep = np.repeat(run >= least, run + 1)
    where = np.flatnonzero(keep)
    index = FMIndex(seq[where])
    low, high = index.search(block.patterns, block.lengths)
    times = np.maximum(high - low, 0)
    pattern = np.repeat(np.arange(len(times)), times)
    at = where[index.locate(np.repeat(low, times) + common.ranges(times))]
    doc = np.searchsorted(ends, at, "right")
    cover = np.zeros(len(seq) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + block.lengths[pattern], -1)
    hit = np.flatnonzero(np.cumsum(cover)[:-1])
    of, first = np.unique(np.searchsorted(ends, hit, "right"), return_index=True)
    hits = {d: h - int(ends[d] - counts[d] - 1) for d, h in zip(of.tolist(), np.split(hit, first[1:]), strict=True)} if len(of) else {}
    items: dict[int, set[str]] = {}
    for d, p in np.unique(np.stack([doc, pattern], 1), axis=0).tolist() if len(doc) else ():
        items.setdefault(d, set()).update(block.items[p])
    return hits, items


def spans(text: bytes, hits: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of hit words; neighbouring words make one span."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    out: list[tuple[int, int]] = []
    for i, h in enumerate(hits.tolist()):
        if i and hits[i - 1] == h - 1:
            out[-1] = (out[-1][0], places[h][1])
        else:
            out.append(places[h])
    return out


def cut(text: bytes, hits: np.ndarray) -> bytes:
    """The text without the spans of hit words."""
    out, at = [], 0
    for s, e in spans(text, hits):
        out.append(text[at:s])
        at = e
    return b"".join([*out, text[at:]])


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cutting: bool = False) -> DataFrame:
    """The columns of ``docs`` plus n_words long, hits array<int> (numbers of hit words, from 0)
    and items array<string>; columns named so in ``docs`` are replaced. When cutting, the
    columns of ``docs``, with the hits cut out of the texts. ``docs`` are read once."""
    kept = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    fields = [docs.schema[c] for c in kept]
    schema = T.StructType(fields if cutting else [*fields, *T._parse_datatype_string("n_words long, hits array<int>, items array<string>").fields])
    parts = blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for a, b in common.slices([len(t or b"") for t in texts], SHARD_BYTES):
                every = [words(t) for t in texts[a:b]]
                hits: dict[int, np.ndarray] = {}
                items: dict[int, set[str]] = {}
                for part in parts:
                    more, names = scan(every, _loaded(part, window))
                    hits |= {d: np.union1d(hits[d], h) if d in hits else h for d, h in more.items()}
                    items |= {d: items.get(d, set()) | x for d, x in names.items()}
                part = batch.slice(a, b - a)
                if cutting:
                    text = pa.array([cut(t, hits[d]) if d in hits else t for d, t in enumerate(texts[a:b])], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([text if c == "text" else part.column(c) for c in kept], names=kept)
                else:
                    new = [pa.array([len(ws) for ws in every], pa.int64()), pa.array([hits[d].tolist() if d in hits else [] for d in range(b - a)], pa.list_(pa.int32())), pa.array([sorted(items.get(d, ())) for d in range(b - a)], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *new], names=schema.names)

    return common.mapped(docs.select(*kept), run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row.

    Null and empty texts have no words. Repeated rows are judged each. Items with null or
    wordless texts have no window; a null item_id is written as the empty string; rows that
    repeat an item_id add windows to that item. An empty benchmark hits nothing, an empty
    table of documents gives no rows. Columns other than doc_id, text and item_id, text
    are not looked at."""
    common.tune(docs.sparkSession)
    found = find(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the merged spans of hit words; all rows and columns stay, n_chars
    follows the text if there is one."""
    common.tune(docs.sparkSession)
    clash = {c: common.unused(docs.columns, f"_kept_{c}") for c in ("n_words", "hits", "items") if c in docs.columns}
    left = find(docs.withColumnsRenamed(clash), benchmark, window, block_bytes, cutting=True)
    left = left.withColumnsRenamed({v: k for k, v in clash.items()})
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
