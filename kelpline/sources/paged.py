"""A data source for answers that come in pages, from a service or from a folder of landed pages.

``spark.read.format("kelpline_pages")`` plans ranges of pages, and each task asks for its own; ``readStream``
goes on where the checkpoint says, so pages that a run has read are never asked for again.
Options: ``location``, an http address or a folder of files named by offset; ``limit``, records of a page;
``pages``, pages of a task; ``attempts`` for an answer that fails.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "kelpline_pages"
SCHEMA = "offset long, endOfRecords boolean, key long, species string, media array<struct<type:string,identifier:string,license:string,creator:string>>"
_MEDIUM = ("type", "identifier", "license", "creator")


class Pages:
    """What is at a location: which offsets there are, and the page of one."""

    def __init__(self, options: dict[str, str]):
        self.location = options["location"].rstrip("/")
        self.limit, self.attempts = int(options.get("limit", "300")), int(options.get("attempts", "3"))
        self.web = self.location.startswith(("http://", "https://"))

    def _ask(self, offset: int, limit: int) -> dict:
        """An answer; a failed one is asked for again after 1, 2, 4 .. seconds, but not if the address is wrong."""
        address = f"{self.location}?{urllib.parse.urlencode({'offset': offset, 'limit': limit})}"
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(address, timeout=60) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if attempt + 1 == self.attempts or (e.code < 500 and e.code != 429):
                    raise
            except (OSError, ValueError):
                if attempt + 1 == self.attempts:
                    raise
            time.sleep(2**attempt)
        raise ValueError("attempts must be one at least")

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.location if "://" in self.location or self.location.startswith("file:") else f"file://{self.location}")

    def offsets(self) -> list[int]:
        """All offsets, ascending. A service tells how many records it has with any answer."""
        if self.web:
            return list(range(0, int(self._ask(0, 1)["count"]), self.limit))
        from pyarrow import fs

        files, path = self._folder()
        names = (f.base_name for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)))
        return sorted(int(m[1]) for m in map(re.compile(r"(\d+)\.json").fullmatch, names) if m)

    def get(self, offset: int) -> dict:
        if self.web:
            return self._ask(offset, self.limit)
        files, path = self._folder()
        name = f"{path}/{offset:012d}.json"
        with files.open_input_stream(name) as f:
            return json.loads(f.read())

    def rows(self, offset: int) -> Iterator[tuple]:
        page = self.get(offset)
        for r in page.get("results") or []:
            media = [tuple(m.get(c) for c in _MEDIUM) for m in r["media"]] if r.get("media") is not None else None
            yield offset, page.get("endOfRecords"), r.get("key"), r.get("species"), media


class Range(InputPartition):
    def __init__(self, offsets: list[int]):
        self.offsets = offsets


def _ranges(offsets: list[int], pages: int) -> list[Range]:
    return [Range(offsets[i : i + pages]) for i in range(0, len(offsets), pages)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.source, self.pages = Pages(options), int(options.get("pages", "8"))

    def partitions(self) -> list[Range]:
        return _ranges(self.source.offsets(), self.pages) or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for offset in partition.offsets:
            yield from self.source.rows(offset)


class _StreamReader(DataSourceStreamReader):
    """The position is the least offset that is not read yet."""

    def __init__(self, options: dict[str, str]):
        self.source, self.pages = Pages(options), int(options.get("pages", "8"))

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        return {"next": max(self.source.offsets(), default=-1) + 1}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges([o for o in self.source.offsets() if start["next"] <= o < end["next"]], self.pages) or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for offset in partition.offsets:
            yield from self.source.rows(offset)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def up_to_last(rows: DataFrame) -> DataFrame:
    """Without the pages after the first that says it is the last."""
    last = rows.filter("endOfRecords").agg(F.min("offset").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).filter("_last is null or offset <= _last").drop("_last", "endOfRecords")


def read(spark: SparkSession, location: str, **options: str) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format(NAME).options(location=location, **options).load()


def stream(spark: SparkSession, location: str, **options: str) -> DataFrame:
    """Pages that come to be there are read once each. The last page of a service may still grow: ask for it when it is whole."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format(NAME).options(location=location, **options).load()
