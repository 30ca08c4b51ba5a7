"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every start of a 50-byte window is a suffix that has to be told apart by 50 bytes and no
further; equal groups at that depth are exactly the windows that repeat. Not every suffix is
sent: of a window's 27 strings of 24 bytes the one of least hash is its anchor, equal windows
have equal anchors at equal places, and a suffix that begins at an anchor stands for the up to
27 windows that share it, about 14 on average.

1. Filter. Suffixes whose first 24 bytes are nowhere else can't repeat. Chunks of documents
   send 48-bit hashes of these bytes; a collision keeps a suffix too many and loses none.
2. Sort. The suffixes that are left are dealt by ranges of their first eight bytes and sorted
   by most-significant-digit passes over their bytes, eight at a time: each pass sorts inside
   the groups of the last and drops suffixes that are alone. After 24 bytes a group shares its
   anchor; the next 26 bytes, and the up to 26 before the anchor, finish all its windows. Only
   where a group's members differ are windows themselves sorted, by all of their 50 bytes.

So equality is always decided by bytes. A chunk sends a suffix with its context once, with the
least doc_id that has it, so a passage that a third of all documents share makes one entry for
each chunk; the answer is a bit for each window. Texts stay where they are: chunks are a table
that is bucketed by chunk, and only hashes, suffixes and answers move.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import common

#: Bytes of a window, of an anchor; bytes of texts in a chunk (a longer text is cut into several), and that are worked on at a time.
WINDOW, ANCHOR = 50, 24
CHUNK, BLOCK = 4 << 20, 1 << 18
#: Bytes that a task of the filter and of the sort gets, about; chunks at least and suffixes of each for the sample that divides the ranges; suffixes of it for a range.
HASHES, ENTRIES, SAMPLE, PER_RANGE = 16 << 20, 12 << 20, (16, 256), 16
_SIDE = WINDOW - ANCHOR  # bytes on each side of an anchor that its windows can reach
_CONTEXT = _SIDE + WINDOW
_ENTRY = _CONTEXT + 2 + 8
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PAD = 128

_Masks = "chunk long, bucket int, mask binary, kept long"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def _sliding(op: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """op over x[i : i + width] for each i."""
    step = 1
    while 2 * step <= width:
        x = op(x[:-step], x[step:])
        step *= 2
    return op(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def _anchor_hashes(words: np.ndarray, n: int) -> np.ndarray:
    h = words[:n] * _ODD[0]
    for i in (1, 2):
        h ^= h >> np.uint64(29)
        h += words[8 * i : 8 * i + n]
        h *= _ODD[i]
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1))


def digits(rows: np.ndarray) -> list[np.ndarray]:
    """The bytes of each row, eight at a time, as numbers in the order of the bytes."""
    width = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), width), np.uint8)
    padded[:, : rows.shape[1]] = rows
    return list(padded.view(">u8").astype(np.uint64).T)


class Radix:
    """Rows in the order of their digits so far, and where groups of equal ones begin."""

    def __init__(self, n: int):
        self.order = np.arange(n)
        self.new = np.zeros(n, bool)
        self.new[:1] = True

    def by(self, columns: list[np.ndarray]) -> "Radix":
        """Passes over further digits; groups of one row are left out of each."""
        for c in columns:
            size = np.diff(np.append(np.flatnonzero(self.new), len(self.order)))
            at = np.flatnonzero(np.repeat(size > 1, size))
            if not len(at):
                break
            group = np.cumsum(self.new)[at]
            rows = self.order[at]
            turn = np.lexsort((c[rows], group))
            self.order[at] = rows = rows[turn]
            value = c[rows]
            self.new[at[1:]] |= value[1:] != value[:-1]
        return self

    def groups(self) -> np.ndarray:
        """The number of each row's group, in the order of the groups."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.new) - 1
        return out


def _least(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The least id of each group."""
    out = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, group, ids)
    return out


class Chunk:
    """Texts of a chunk, end to end, with the suffixes that begin at anchors."""

    def __init__(self, doc_ids: list[int | None], lengths: list[int], data: bytes):
        self.size = len(data)
        self.data = np.frombuffer(bytes(_PAD) + data + bytes(_PAD), np.uint8)  # places are from the first text's begin
        self.ends = np.cumsum(np.array(lengths, np.int64))
        self.begins = self.ends - lengths
        self.null = np.array([d is None for d in doc_ids], bool)
        self.doc_ids = np.array([0 if d is None else d for d in doc_ids], np.int64)
        found = [self._anchors(a, min(a + BLOCK, self.size)) for a in range(0, self.size, BLOCK)]
        self.place, value, self.low, self.high = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        self.key = _mixed(value)
        self.doc = np.searchsorted(self.ends, self.place, "right")

    def _anchors(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Anchors that begin in a..b: place, hash, and the least and greatest distance back to the
        windows that have it."""
        first, last = max(0, a - _SIDE), min(self.size, b + _SIDE)
        words = np.ndarray((last - first + 2 * WINDOW,), "<u8", self.data, _PAD + first, (1,))
        h = _anchor_hashes(words, last - first)
        starts = np.arange(first, b)  # windows from which anchors in a..b can be reached
        least = _sliding(np.minimum, np.append(h, np.full(_SIDE, np.iinfo(np.uint64).max, np.uint64)), _SIDE + 1)[: len(starts)].copy()
        # windows that leave their text, and texts without a doc_id, have no anchor
        text = np.searchsorted(self.ends, starts, "right")
        text = np.minimum(text, max(0, len(self.ends) - 1))
        least[(starts + WINDOW > self.ends[text]) | self.null[text]] = 0
        padded = np.concatenate([np.zeros(_SIDE, np.uint64), least])
        most = _sliding(np.maximum, padded, _SIDE + 1)  # over the windows first+i-26 .. first+i
        own = h[: len(most)]
        p = np.flatnonzero(most == own)
        p = p[p >= a - first]
        if not len(p):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        low, high = np.full(len(p), 255, np.uint8), np.zeros(len(p), np.uint8)
        for back in range(_SIDE + 1):
            mine = padded[p + _SIDE - back] == own[p]
            low[mine & (low == 255)] = back
            high[mine] = back
        return p + first, own[p], low, high

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Bytes around places: the suffix, then the bytes before it, the nearest first; zero beyond
        what the windows reach."""
        rows = self.data[(self.place[at] + _PAD)[:, None] + np.concatenate([np.arange(WINDOW), -1 - np.arange(_SIDE)])]
        low, high = self.low[at].astype(int)[:, None], self.high[at].astype(int)[:, None]
        k = np.arange(_CONTEXT)[None, :]
        rows[np.where(k < WINDOW, k >= WINDOW - low, k - WINDOW >= high)] = 0
        return rows


def _cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the ordered keys begins, and the end."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1))


class Passes:
    """What a chunk knows after the answers to the filter and to the sort."""

    def __init__(self, row: dict, buckets: int, edges: np.ndarray | None = None):
        self.chunk = c = Chunk(row["doc_ids"], row["lengths"], pa.decompress(row["data"], sum(row["lengths"]), "zstd", asbytes=True) if row["data"] else b"")
        self.keys, of = np.unique(c.key, return_inverse=True)
        self.cuts = _cut(self.keys, buckets)
        if "masks1" not in row:
            return
        # anchors that more than one document has, here or elsewhere
        low, high = np.full(len(self.keys), len(c.ends)), np.full(len(self.keys), -1)
        np.minimum.at(low, of, c.doc)
        np.maximum.at(high, of, c.doc)
        elsewhere = np.zeros(len(self.keys), bool)
        for m in row["masks1"] or ():
            a, b = int(self.cuts[m["bucket"]]), int(self.cuts[m["bucket"] + 1])
            elsewhere[a:b] = np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=b - a)
        self.at = np.flatnonzero((elsewhere | (low != high))[of])
        self.ids = c.doc_ids[c.doc[self.at]]
        # distinct suffixes with their contexts, some at a time, so that a text of one byte needs little
        parts, of, n = [], np.zeros(len(self.at), np.int64), 0
        for s in range(0, len(self.at), 1 << 14):
            at = self.at[s : s + (1 << 14)]
            rows = np.concatenate([c.contexts(at), c.low[at][:, None], c.high[at][:, None]], 1)
            r = Radix(len(rows)).by(digits(rows))
            of[s : s + len(at)] = r.groups() + n
            parts.append(rows[r.order[r.new]])
            n += len(parts[-1])
        rows = np.concatenate(parts) if parts else np.zeros((0, _CONTEXT + 2), np.uint8)
        columns = digits(rows)
        r = Radix(n).by(columns)
        self.of = r.groups()[of]
        self.rows = rows[r.order[r.new]]
        self.least = _least(self.of, self.ids)
        self.ranges = np.searchsorted(_anchors(self.rows), edges) if edges is not None else np.zeros(0, np.int64)
        self.ranges = np.concatenate([[0], self.ranges, [len(self.rows)]])
        if "masks2" not in row:
            return
        self.bits = np.zeros(len(self.rows), np.uint32)
        for m in row["masks2"] or ():
            self.bits[int(self.ranges[m["bucket"]]) : int(self.ranges[m["bucket"] + 1])] = np.frombuffer(m["mask"], "<u4")

    def entries(self, level: int) -> Iterator[tuple[int, bytes]]:
        if level == 1:
            cuts, parts = self.cuts, [np.ascontiguousarray(self.keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])]
        else:
            cuts, parts = self.ranges, [self.rows, self.least]
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            yield b, b"".join(p[cuts[b] : cuts[b + 1]].tobytes() for p in parts)

    def gone(self) -> np.ndarray:
        """Whether each byte of the chunk is removed."""
        c = self.chunk
        cover = np.zeros(c.size + 1, np.int32)
        place, low, high = c.place[self.at], c.low[self.at].astype(np.int64), c.high[self.at].astype(np.int64)
        whole = self.ids > self.least[self.of]
        np.add.at(cover, (place - high)[whole], 1)
        np.add.at(cover, (place - low)[whole] + WINDOW, -1)
        some = np.flatnonzero(~whole & (self.bits[self.of] != 0))
        n = high[some] - low[some] + 1
        row, back = np.repeat(some, n), np.repeat(low[some], n) + common.ranges(n)
        hit = (self.bits[self.of[row]] >> back.astype(np.uint32)) & 1 == 1
        np.add.at(cover, (place[row] - back)[hit], 1)
        np.add.at(cover, (place[row] - back)[hit] + WINDOW, -1)
        return np.cumsum(cover[:-1]) > 0


def _runs(gone: np.ndarray) -> list[int]:
    """Begin and end of each run."""
    return np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist() if gone.any() else []


def _answers_filter(parts: list[bytes]) -> list[tuple[bytes, int]]:
    """Which hashes more than one chunk has, and how many."""
    keys = []
    for p in parts:
        wide = np.zeros((len(p) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(p, np.uint8).reshape(-1, 6)
        keys.append(wide.view("<u8").ravel())
    every = np.sort(np.concatenate(keys))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for k in keys:
        hit = again[np.minimum(np.searchsorted(again, k), max(len(again) - 1, 0))] == k if len(again) else np.zeros(len(k), bool)
        out.append((np.packbits(hit).tobytes(), int(hit.sum())))
    return out


def _answers_sort(parts: list[bytes]) -> list[tuple[bytes, int]]:
    """For each suffix a bit for each window, by its distance back: whether a smaller doc_id has it."""
    counts = [len(p) // _ENTRY for p in parts]
    rows = np.concatenate([np.frombuffer(p, np.uint8, n * (_CONTEXT + 2)).reshape(n, -1) for p, n in zip(parts, counts, strict=True)])
    ids = np.concatenate([np.frombuffer(p, "<i8", n, n * (_CONTEXT + 2)) for p, n in zip(parts, counts, strict=True)])
    columns = digits(rows)
    r = Radix(len(rows)).by(columns[: ANCHOR // 8])
    anchor = r.groups()
    context = r.by(columns[ANCHOR // 8 :]).groups()
    least = _least(context, ids)
    bits = np.where(ids > least[context], np.uint32(0xFFFFFFFF), np.uint32(0))
    # windows of anchors that are in several contexts
    one = r.order[r.new]  # a row of each context, in order
    own = anchor[one]
    several = np.flatnonzero(np.bincount(own, minlength=1)[own] > 1)
    found = np.zeros(len(one), np.uint32)
    step = max(1, (1 << 22) // (WINDOW * (_SIDE + 1)))
    starts = np.flatnonzero(np.concatenate([[True], own[several][1:] != own[several][:-1]])) if len(several) else np.zeros(0, np.int64)
    for s, e in common.slices(np.diff(np.append(starts, len(several))).tolist(), step):  # whole anchors at a time
        here = several[starts[s] : starts[e] if e < len(starts) else len(several)]
        low, high = rows[one[here], _CONTEXT].astype(np.int64), rows[one[here], _CONTEXT + 1].astype(np.int64)
        n = high - low + 1
        which, back = np.repeat(here, n), np.repeat(low, n) + common.ranges(n)
        # a window: bytes back .. 1 before the anchor, then the first of the suffix
        k = np.arange(WINDOW)[None, :]
        at = np.where(k < back[:, None], WINDOW + back[:, None] - 1 - k, k - back[:, None])
        window = np.take_along_axis(rows[one[which]], at, 1)
        w = Radix(len(which)).by([own[which].astype(np.uint64) * np.uint64(64) + back.astype(np.uint64), *digits(window)]).groups()
        smaller = _least(w, least[which])[w] < least[which]
        np.bitwise_or.at(found, which[smaller], np.uint32(1) << back[smaller].astype(np.uint32))
    bits |= found[context]
    return [(x.astype("<u4").tobytes(), 0) for x in np.split(bits, np.cumsum(counts)[:-1])]


def _chunked(docs: DataFrame, partitions: int) -> tuple[DataFrame, str]:
    """The documents in chunks, as a table that is bucketed by chunk, and its name. A text longer
    than a chunk is cut into parts, each going on for the rest of a window: ``part`` is its place,
    -1 for chunks of whole texts, and ``whole`` numbers the long texts."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def chunk(ids: list[int | None], texts: list[bytes], part: int, whole: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            data = pa.compress(b"".join(texts), "zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([data]), pa.array([part], pa.int32()), pa.array([whole])], names=["chunk", "doc_ids", "lengths", "data", "part", "whole"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                if len(text) > CHUNK:
                    whole = number + 1
                    for part, a in enumerate(range(0, len(text), CHUNK)):
                        yield chunk([doc_id], [text[a : a + CHUNK + WINDOW - 1]], part, whole)
                    continue
                if texts and size + len(text) > CHUNK:
                    yield chunk(ids, texts, -1, -1)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if texts:
            yield chunk(ids, texts, -1, -1)

    name = f"kelpline_chunks_{uuid.uuid4().hex}"
    rows = common.mapped(docs.select("doc_id", "text"), run, "chunk long, doc_ids array<long>, lengths array<long>, data binary, part int, whole long")
    rows.write.format("parquet").option("compression", "none").option("path", common.scratch_path(spark, "chunks")).bucketBy(partitions, "chunk").saveAsTable(name)
    return spark.table(name), name


def _anchors(rows: np.ndarray) -> np.ndarray:
    """The first bytes of each row, an anchor's, as values that compare as these bytes do."""
    return np.ascontiguousarray(rows[:, :ANCHOR]).view(f"S{ANCHOR}").ravel()


def _edges(chunks: DataFrame, n: int, ranges: int) -> np.ndarray:
    """Where ranges of suffixes begin, by all the bytes of their anchors, from a sample of some suffixes for
    each range. Suffixes of one anchor are compared together, so a range is not cut further."""
    least, each = SAMPLE
    some = max(least, -(-ranges * PER_RANGE // each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = Passes(row, 1).chunk
                at = np.arange(len(c.place))[:: max(1, len(c.place) // each)][:each]
                lead = _anchors(c.contexts(at)).tolist() if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(lead, pa.binary())], names=["lead"])

    rate = max(1, -(-n // some))
    drawn = chunks.select("doc_ids", "lengths", "data").filter(F.pmod(F.xxhash64("chunk", F.lit("sample")), F.lit(rate)) == 0).limit(4 * some)
    found = np.sort(np.array([bytes(r["lead"]) for r in common.mapped(drawn, run, "lead binary").collect()], f"S{ANCHOR}"))
    return np.unique(found[np.arange(1, ranges) * len(found) // ranges]) if len(found) else found


def repeated_strings(docs: DataFrame) -> DataFrame:
    """Remove each byte that a 50-byte string covers which also starts in a document with a
    smaller doc_id. A row per document (doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, and spans array<long>: begin and end of each removed run, in bytes.

    Null texts count as empty. Rows that share a doc_id don't remove from one another. A
    null doc_id is neither smaller nor larger than others: such rows lose nothing and take
    nothing. An empty table gives no rows; other columns are not looked at. A text of any
    length is worked on in parts of ``CHUNK`` bytes; only the last step, which hashes what is
    left of it, holds a long text whole, as its row does."""
    spark = docs.sparkSession
    common.tune(spark)
    chunks, name = _chunked(docs, common.width(spark))
    n, size = chunks.agg(F.count("*"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    buckets = max(common.width(spark), -(-size * 6 // 13 // HASHES))
    edges = None

    def send(level: int, edges: np.ndarray | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    out = list(Passes(row, buckets, edges).entries(level))
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([row["chunk"]] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())], names=["bucket", "chunk", "data"])

        return run

    def answer(answers: Callable[[list[bytes]], list[tuple[bytes, int]]]):
        def run(table: pa.Table) -> pa.Table:
            found = answers(table.column("data").to_pylist())
            return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "mask": pa.array([m for m, _ in found], pa.binary()), "kept": pa.array([k for _, k in found], pa.int64())})

        return run

    known = chunks
    for level, answers in ((1, _answers_filter), (2, _answers_sort)):
        sent = common.mapped(known, send(level, edges), "bucket int, chunk long, data binary")
        got = sent.groupBy("bucket").applyInArrow(answer(answers), _Masks)
        masks = common.stored(got.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "mask")).alias(f"masks{level}"), F.sum("kept").alias(f"kept{level}")), f"digits{level}")
        known = known.join(masks, "chunk", "left")
        if level == 1:
            kept = masks.agg(F.coalesce(F.sum("kept1"), F.lit(0))).first()[0]
            edges = _edges(chunks, n, max(common.width(spark), -(-kept * _ENTRY // ENTRIES)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                known = Passes(row, buckets, edges)
                gone, c, rows = known.gone(), known.chunk, []
                data = c.data[_PAD : _PAD + c.size]
                for k, (a, b) in enumerate(zip(c.begins.tolist(), c.ends.tolist(), strict=True)):
                    doc_id = None if c.null[k] else int(c.doc_ids[k])
                    if row["part"] >= 0:
                        begin = row["part"] * CHUNK
                        rows.append((doc_id, None, None, None, None, [begin + x for x in _runs(gone)], row["whole"], row["part"], data[:CHUNK].tobytes()))
                    else:
                        rows.append((doc_id, *_cut_text(data[a:b], gone[a:b]), None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*(f.split()[0] for f in _RESULT.split(", ")), "whole", "part", "data"])

    def assemble(table: pa.Table) -> pa.Table:
        parts = sorted(table.select(["part", "data", "spans", "doc_id"]).to_pylist(), key=lambda r: r["part"])
        data = np.frombuffer(b"".join(p["data"] for p in parts), np.uint8)
        gone = np.zeros(len(data) + 1, np.int32)
        for p in parts:
            np.add.at(gone, np.array(p["spans"][::2], np.int64), 1)
            np.add.at(gone, np.array(p["spans"][1::2], np.int64), -1)
        row = (parts[0]["doc_id"], *_cut_text(data, np.cumsum(gone[:-1]) > 0))
        return pa.table({f.split()[0]: pa.array([x], t) for f, x, t in zip(_RESULT.split(", "), row, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)})

    out = common.stored(common.mapped(known, finish, f"{_RESULT}, whole long, part int, data binary"), "removed")
    spark.sql(f"drop table {name}")  # the chunks' files stay with the other scratch files
    names = [f.split()[0] for f in _RESULT.split(", ")]
    return out.filter("whole is null").select(*names).unionByName(out.filter("whole is not null").groupBy("whole").applyInArrow(assemble, _RESULT))


def _cut_text(text: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str, list[int]]:
    """Of a text: bytes, removed bytes, removed runs, hash of the rest, runs."""
    runs = _runs(gone)
    kept = text[~gone] if runs else text
    return len(text), len(text) - len(kept), len(runs) // 2, hashlib.sha256(kept.tobytes()).hexdigest(), runs


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(common.documents(spark, sf_dir)).drop("spans")
