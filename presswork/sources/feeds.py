"""Feeds, pages and archives as DataFrames. Fetching is a function that callers pass in: offline
runs read files, so nothing here opens a connection by itself."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = "feed string, link string, title string, author string, published_at string, snippet string, error string"


def read_rss_files(spark: SparkSession, path: str) -> DataFrame:
    """Items of stored RSS files by Spark's own XML source; items without link or title are dropped."""
    fields = "title string, link string, pubDate string, description string, author string, creator string"
    raw = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(fields).load(path)
    kept = raw.where("link is not null and title is not null")
    return kept.select("link", "title", F.coalesce("creator", "author").alias("author"), F.col("pubDate").alias("published_at"), F.col("description").alias("snippet"))


def parse_feed(text: str) -> list[dict]:
    """Items of an RSS or Atom document."""
    name = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    out = []
    for node in ET.fromstring(text).iter():
        if name(node) not in ("item", "entry"):
            continue
        got: dict[str, str] = {}
        for child in node:
            value = child.get("href") if name(child) == "link" and child.get("href") else "".join(child.itertext()).strip()
            got.setdefault(name(child), value)
        link, title = got.get("link"), got.get("title")
        if link and title:
            out.append({"link": link, "title": title, "author": got.get("creator") or got.get("author"), "published_at": got.get("published") or got.get("pubdate") or got.get("updated"), "snippet": got.get("description") or got.get("summary")})
    return out


def fetch_feeds(urls: DataFrame, fetch: Callable[[str], str], concurrency: int = 3) -> DataFrame:
    """Items of every feed of ``urls`` (column url); a feed that fails gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ITEM.split(", ")]
        for frame in frames:
            rows = []
            for url in frame["url"]:
                try:
                    rows += [{"feed": url, "error": None, **item} for item in parse_feed(fetch(url))]
                except Exception as e:  # an error is a value here: one feed must not end the batch
                    rows.append({"feed": url, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return urls.select("url").repartition(concurrency).mapInPandas(run, ITEM)


_SKIP = {"script", "style", "nav", "aside", "footer", "header", "noscript", "form", "svg", "template", "button"}
_BLOCK = {"p", "div", "section", "article", "main", "li", "h1", "h2", "h3", "h4", "blockquote", "br", "tr", "pre"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr"}
_AD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookie\w*|newsletter|share|related|comments?)(?:$|[\s_-])", re.IGNORECASE)


class _Text(HTMLParser):
    """Text blocks of a page with whether they stand in its main element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.skip, self.main = 0, 0
        self.blocks: list[tuple[bool, str]] = []
        self.now: list[str] = []

    def _close(self) -> None:
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append((self.main > 0, text))
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._close()
        if tag in _VOID:
            return
        named = dict(attrs)
        off = tag in _SKIP or bool(_AD.search(f"{named.get('class') or ''} {named.get('id') or ''}"))
        self.stack.append((tag, off))
        self.skip += off
        self.main += tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._close()
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, off = self.stack.pop()
            self.skip -= off
            self.main -= t in ("article", "main")
            if t == tag:
                break

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)


def main_text(page: str | None) -> str | None:
    """Main content of an HTML page: its article or main element, else all its blocks of prose."""
    if not page:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    parser._close()
    inner = [t for m, t in parser.blocks if m]
    chosen = inner if sum(map(len, inner)) >= 80 else [t for _, t in parser.blocks if len(t) >= 40]
    return "\n\n".join(html.unescape(t) for t in chosen) or None


def main_text_udf():
    @F.pandas_udf(T.StringType())
    def extracted(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return extracted


def parse_cdx(spark: SparkSession, path: str) -> DataFrame:
    """(url, stamp) of stored archive listings: JSON arrays of rows whose first is a header."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("n", "row"))
    return rows.where("n > 0").select(F.col("row")[2].alias("url"), F.col("row")[1].alias("stamp"))
