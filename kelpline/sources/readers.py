"""Readers of the files that the pipelines exchange. All give a DataFrame with an explicit
schema; nothing is inferred from data."""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.text import has_suffix, page_number
from kelpline.schemas import TABLES, with_columns_of
from kelpline.sources.scratch import stored

# Which files count as images, by step.
IMAGES = (".jpg", ".jpeg", ".png", ".webp")
SUFFIXES = {"validate": IMAGES, "labels": (*IMAGES, ".bmp"), "prepare": (*IMAGES, ".bmp", ".tiff"), "evaluate": (*IMAGES, ".bmp", ".gif")}


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def one(df: DataFrame) -> dict | None:
    """The first row, or None."""
    row = df.limit(1).head()
    return row.asDict() if row else None


def scalar(df: DataFrame) -> object | None:
    row = df.limit(1).head()
    return row[0] if row else None


def json_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """JSON lines of a base table's schema; absent keys are null, blank lines are skipped."""
    return spark.read.schema(TABLES[name]).json(path)


def last_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last record of a key, as when lines are read into a dictionary."""
    row = F.max_by(F.struct(*df.columns), order)
    return df.groupBy(key).agg(row.alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def nested_map(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON object of objects, as rows: its keys in ``key``, the fields of ``value`` (DDL)."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<{value}>>").alias("m"))
    return whole.select(F.explode("m").alias(key, "_v")).select(key, "_v.*")


def _file_name() -> Column:
    """The name of the file that a row comes from, as it was written: paths of files are encoded."""
    return F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B")))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Export pages in order: file, page, html."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.html")
    name = _file_name()
    return files.select(name.alias("file"), page_number(name).alias("page"), F.col("value").alias("html"))


def images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGES, recursive: bool = True) -> DataFrame:
    """path, class (the parent folder), stem and size of images, without their bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path if recursive else f"{path}/*")
    name = F.element_at(F.split("path", "/"), -1)
    return found.filter(has_suffix(F.col("path"), suffixes)).select("path", F.element_at(F.split("path", "/"), -2).alias("cls"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), "length")


#: Bytes of packed entries that one task reads.
ZIP_TASK = 64 << 20


def zip_entries(spark: SparkSession, path: str, task_bytes: int = ZIP_TASK) -> DataFrame:
    """(archive, entry, content) of the files in landed archives. Only an archive's directory is read to plan: entries
    are dealt to tasks by their packed bytes, and a task reads the ranges of its own, so one large
    archive is unpacked by many tasks and none holds a whole one. Folders are left out, and what
    isn't a sound archive has no rows."""

    def directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with _opened(name) as f, zipfile.ZipFile(f) as archive:
                        entries = [e for e in archive.infolist() if not e.is_dir()]
                except (zipfile.BadZipFile, pa.ArrowInvalid):  # too short to have a directory
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(entries), pa.string()), pa.array([e.filename for e in entries], pa.string()), pa.array([e.header_offset for e in entries], pa.int64()), pa.array([e.compress_size for e in entries], pa.int64())], names=["path", "entry", "at", "packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list[int]] = {}
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.setdefault(name, []).append(at)
            for name, places in rows.items():
                with _opened(name) as f, zipfile.ZipFile(f) as archive:
                    by_place = {e.header_offset: e for e in archive.infolist()}
                    for at in sorted(places):
                        entry = by_place[at]
                        yield pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([entry.filename]), pa.array([archive.read(entry)], pa.binary())], names=["archive", "entry", "content"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path")
    entries = stored(found.mapInArrow(directory, "path string, entry string, at long, packed long"), "entries")
    total = entries.agg(F.coalesce(F.sum("packed"), F.lit(0)).alias("n"), F.count("*").alias("c")).first()
    tasks = max(1, min(total["c"], max(-(-total["n"] // task_bytes), spark.sparkContext.defaultParallelism)))
    return entries.select("path", "at").repartition(tasks, "path", "at").mapInArrow(unpack, "archive string, entry string, content binary")


def _opened(path: str):
    """A file of a store that ``pyarrow.fs`` opens, for reads of ranges."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def image_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the first bytes of a JPEG, PNG, GIF, BMP or WebP file; None if they don't say."""
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
            return struct.unpack(">II", head[16:24])
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", head[6:10])
        if head[:2] == b"BM":
            width, height = struct.unpack("<ii", head[18:26])
            return width, abs(height)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            if head[12:16] == b"VP8X":
                return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
            if head[12:16] == b"VP8L":
                bits = int.from_bytes(head[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            if head[12:16] == b"VP8 ":
                width, height = struct.unpack("<HH", head[26:30])
                return width & 0x3FFF, height & 0x3FFF
        if head[:2] == b"\xff\xd8":
            at = 2
            while at + 9 <= len(head):
                if head[at] != 0xFF:
                    return None
                kind = head[at + 1]
                if kind == 0xFF:  # filling
                    at += 1
                elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    height, width = struct.unpack(">HH", head[at + 5 : at + 9])
                    return width, height
                else:
                    at += 2 if kind == 1 or 0xD0 <= kind <= 0xD8 else 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    except struct.error:
        pass
    return None


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """filename, content, width and height; -1 for files that can't be decoded. Files are read once: sizes are
    in their first bytes, no pixel is decoded for them, and a file counts as whole if it ends as its format does. A file whose
    header says nothing has -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column(1).to_pylist()
            sizes = [image_size(c) if _ends(c) else None for c in content]
            width, height = ([s[k] if s and s[0] > 0 and s[1] > 0 else -1 for s in sizes] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(width, pa.int32()), pa.array(height, pa.int32())], names=["filename", "content", "width", "height"])

    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content").mapInArrow(run, "filename string, content binary, width int, height int")


def _ends(content: bytes) -> bool:
    """Whether a file has the end of its format, so that none is taken for whole that was cut off."""
    if content[:2] == b"\xff\xd8":
        return b"\xff\xd9" in content[-64:]
    if content[:4] == b"\x89PNG":
        return b"IEND" in content[-64:]
    if content[:3] == b"GIF":
        return b";" in content[-8:]
    if content[:2] == b"BM":
        return len(content) >= int.from_bytes(content[2:6], "little")
    if content[:4] == b"RIFF":
        return len(content) >= 8 + int.from_bytes(content[4:8], "little")
    return False


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stem, line, value) of label files. Files are small: a file's lines are numbered as one text."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    name = F.regexp_replace(_file_name(), r"\.txt$", "")
    return files.select(name.alias("stem"), F.posexplode(F.split("value", "\n")).alias("line", "value"))


def naive_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Comma-separated lines without quoting; the first line of a file is its header, lines with
    too few fields are skipped."""
    files = spark.read.text(path, wholetext=True)
    rows = files.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).filter("line > 0")
    parts = F.split("value", ",")
    return rows.filter(F.size(parts) >= len(columns)).select(*[F.trim(parts[i]).alias(c) for i, c in enumerate(columns)])


def yaml_names(text: str) -> list[str]:
    """The ``names`` list of a small YAML file: inline, dashed, or numbered."""
    inline = re.search(r"^names:\s*\[(.*?)\]", text, re.M | re.S)
    if inline:
        return [x.strip().strip("'\"") for x in inline[1].split(",") if x.strip()]
    block = re.search(r"^names:\s*\n((?:[ \t]*(?:-|\d+:)[^\n]*\n?)+)", text, re.M)
    return [re.sub(r"^[ \t]*(?:-|\d+:)\s*", "", x).strip().strip("'\"") for x in block[1].splitlines() if x.strip()] if block else []


def yaml_lists(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, name) of the ``names`` lists of small YAML files, in the three forms that ``yaml_names`` reads. Each
    file is one row of its own; a file without a list has no rows."""
    files = spark.read.text(path, wholetext=True)
    inline = F.regexp_extract("value", r"(?ms)^names:\s*\[(.*?)\]", 1)
    # the repeated group gives nothing back: Java's matcher otherwise goes one call deeper for each line
    block = F.regexp_extract("value", r"(?m)^names:\s*\n((?:[ \t]*(?:-|\d+:)[^\n]*\n?)++)", 1)
    dashed = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^[ \t]*(?:-|\d+:)\s*", ""))
    items = F.when(F.col("value").rlike(r"(?m)^names:\s*\["), F.split(inline, ",")).otherwise(dashed)
    names = F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", "")), lambda x: x != "")
    return files.select(_file_name().alias("file"), F.posexplode(names).alias("i", "name"))


def legacy(spark: SparkSession, frames: list[DataFrame], name: str, alternatives: dict[str, list[str]]) -> DataFrame:
    """Tables of older layouts in the present one. Of a column's old names the first that a table
    has is taken, even if its values are null."""
    out = None
    for df in frames:
        for column, old in alternatives.items():
            present = next((c for c in old if c in df.columns), None)
            if present and present != column:
                df = df.withColumn(column, F.col(present))
        df = with_columns_of(df, name)
        out = df if out is None else out.unionByName(df)
    return out if out is not None else spark.createDataFrame([], TABLES[name])


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of an occurrence search: offset, endOfRecords and results with media. Pages
    after the first that says it is the last are left out."""
    schema = "offset long, endOfRecords boolean, results array<struct<key:long,species:string,media:array<struct<type:string,identifier:string,license:string,creator:string>>>>"
    found = spark.read.schema(schema).json(path)
    last = found.filter("endOfRecords").agg(F.min("offset").alias("_last"))
    return found.crossJoin(F.broadcast(last)).filter("_last is null or offset <= _last").select("offset", F.explode("results").alias("r")).select("offset", "r.*")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages of an observation search: page and results with photos."""
    schema = "page int, results array<struct<id:long,quality_grade:string,taxon:struct<name:string>,photos:array<struct<id:long,url:string,license_code:string>>>>"
    return spark.read.schema(schema).json(path).select("page", F.explode("results").alias("r")).select("page", "r.*")


def image_infos(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers of an image search, a map of pages, one row per image."""
    info = "struct<title:string,imageinfo:array<struct<url:string,mime:string,width:int,height:int,size:long,license:string>>>"
    found = spark.read.schema(f"query struct<pages:map<string,{info}>>").json(path)
    rows = found.select(F.explode("query.pages").alias("page_id", "p")).select("page_id", "p.title", F.explode("p.imageinfo").alias("i"))
    return rows.select("page_id", "title", "i.*")


def weather(spark: SparkSession, path: str) -> DataFrame:
    """A landed forecast, a row per day; its arrays run side by side."""
    daily = "time:array<string>,weathercode:array<int>,precipitation_sum:array<double>,temperature_2m_max:array<double>,temperature_2m_min:array<double>"
    found = spark.read.schema(f"latitude double, longitude double, daily struct<{daily}>").json(path)
    names = ("weathercode", "precipitation_sum", "temperature_2m_max", "temperature_2m_min")
    nothing = F.transform("daily.time", lambda _: F.lit(None))  # for an array that the answer lacks
    zipped = F.arrays_zip(F.col("daily.time").alias("time"), *[F.coalesce(f"daily.{n}", nothing).alias(n) for n in names])
    return found.select("latitude", "longitude", F.explode(zipped).alias("d")).select("latitude", "longitude", "d.*")


def cached(df: DataFrame, cache: DataFrame, path: Column, version: str, backend: str) -> tuple[DataFrame, DataFrame]:
    """(known, new): rows whose result is in the cache, joined with it, and the others with their
    key: the first 20 digits of the SHA-1 of path, version and backend."""
    key = F.substring(F.sha1(F.concat_ws("|", path, F.lit(version), F.lit(backend))), 1, 20)
    keyed = df.withColumn("cache_key", key)
    return keyed.join(cache, "cache_key"), keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
