"""Messages of an exported chat, from its HTML pages.

Pages are parsed one by one on the executors, with the standard library; a page is a bounded
file. What goes over pages (senders, first references) is done on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.functions.rules import export_epoch, iso_utc
from kelpline.functions.text import is_photo_ref
from kelpline.operators.intake import carried_sender, first_seen

_SCHEMA = "page int, position int, msg_id long, date string, has_name boolean, from_name string, href string, caption string"


class _Messages(HTMLParser):
    """Divs with both classes ``message`` and ``default``: number, date, name, photo links, text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.found, self.fields, self.message = 0, [], [], None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "a" and self.message is not None and "photo_wrap" in classes and self.message["href"] is None:
            self.message["href"] = a.get("href") or ""
        if tag != "div":
            return
        self.depth += 1
        if self.message is None and {"message", "default"} <= set(classes):
            self.message = {"id": a.get("id") or "", "depth": self.depth, "date": None, "name": None, "href": None, "text": [], "seen": set()}
        elif self.message is not None:
            if "date" in classes and self.message["date"] is None:
                self.message["date"] = a.get("title") or ""
            for name in ("from_name", "text"):
                if name in classes and name not in self.message["seen"]:
                    self.message["seen"].add(name)
                    self.message["name"] = "" if name == "from_name" else self.message["name"]
                    self.fields.append((self.depth, name))

    def handle_endtag(self, tag: str) -> None:
        if tag != "div" or not self.depth:
            return
        if self.fields and self.fields[-1][0] == self.depth:
            self.fields.pop()
        if self.message is not None and self.message["depth"] == self.depth:
            self.found.append(self.message)
            self.message, self.fields = None, []
        self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.message is not None and self.fields:
            if self.fields[-1][1] == "text":
                self.message["text"].append(data.strip())
            else:
                self.message["name"] += data.strip()


def _rows(page: int, html: str | None) -> list[tuple]:
    p = _Messages()
    p.feed(html or "")
    p.close()
    out = []
    for i, m in enumerate(p.found):
        number = m["id"].removeprefix("message")
        has_name = m["name"] is not None
        out.append((page, i, int(number) if number.lstrip("-").isdigit() else None, m["date"], has_name, m["name"], m["href"] or None, "".join(m["text"])))
    return out


def messages(pages: DataFrame) -> DataFrame:
    """A row per message of pages (page, html), with its first photo link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        for pdf in batches:
            rows = [r for page, html in zip(pdf["page"], pdf["html"], strict=True) for r in _rows(int(page), html)]
            yield pd.DataFrame(rows, columns=names).astype({"msg_id": "Int64"})

    return pages.select("page", "html").mapInPandas(run, _SCHEMA)


def manifest(pages: DataFrame, source: str, license_: str, present: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, duplicates): a record per photo, at its first reference over all pages in order,
    and the later references. The sender of joined messages is carried on inside a page.
    ``present`` (filename): the photos that exist; others are marked as errors."""
    named = carried_sender(messages(pages), ["page"], ["position"], "from_name", F.col("has_name"))
    photos = named.filter(is_photo_ref(F.col("href"))).withColumnRenamed("href", "filename")
    first = first_seen(photos, "filename", F.col("page"), F.col("position"))
    later = photos.join(first.select("filename", "page", "position"), ["filename", "page", "position"], "left_anti")
    epoch = export_epoch(F.col("date"))
    records = first.select("filename", "msg_id", epoch.alias("timestamp"), iso_utc(epoch).alias("timestamp_iso"), "sender_name", "caption", F.lit(source).alias("source"), F.lit(license_).alias("license"))
    if present is None:
        return records.withColumn("parse_error", F.lit(False)), later
    there = present.select("filename").distinct().withColumn("_there", F.lit(True))
    return records.join(there, "filename", "left").withColumn("parse_error", F.col("_there").isNull()).drop("_there"), later
