"""Feeds (RSS 2, Atom) and a JSON article list."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.dates import norm_date
from quern.sources.html import read_blocks

ENTRY_TAGS, TITLE_CHARS, SUMMARY_CHARS = ("item", "entry"), 300, 2000
API_SCHEMA = "array<struct<title:string,url:string,published_at:string,description:string,id:bigint,tag_list:array<string>,user:struct<name:string>>>"


def _local(tag: object) -> str:
    return str(tag).rpartition("}")[2].lower()


def _first(entry: ET.Element, names: tuple[str, ...]) -> str:
    """The first child of one of the names, in document order, that has text."""
    texts = ("".join(x.itertext()).strip() for x in entry if _local(x.tag) in names)
    return next((t for t in texts if t), "")


def _link(entry: ET.Element) -> str:
    """The address of the first link that has one, as attribute or as text."""
    links = ((x.get("href") or x.text or "").strip() for x in entry if _local(x.tag) == "link")
    return next(filter(None, links), "")


def _summary(entry: ET.Element) -> str:
    """Of the first child with any of these names, even an empty one."""
    found = next((x for x in entry if _local(x.tag) in ("description", "summary", "content", "encoded")), None)
    return "" if found is None else "".join(found.itertext())


def _plain(markup: str) -> str:
    """The text of a piece of markup, a line a block."""
    return "\n".join(text for _, text, _, _ in read_blocks(markup))


def _root(xml: str) -> ET.Element | None:
    """The document's element. A declaration may be false (another encoding than the text has now) or misplaced: it is tried without."""
    body = xml.strip()
    bare = body.partition("?>")[2] if body.startswith("<?xml") else body
    for text in (xml, bare):
        try:
            return ET.fromstring(text)
        except (ET.ParseError, ValueError):
            pass
    return None


def parse_feed(xml: str | None, base: str | None) -> list[tuple[str, str, str, str]]:
    """(title, url, date text, summary) of each entry with title and link; a malformed feed has none."""
    root = _root(xml or "")
    out = []
    for entry in root.iter() if root is not None else ():
        if _local(entry.tag) in ENTRY_TAGS:
            title, link = " ".join(_plain(_first(entry, ("title",))).split()), _link(entry)
            if title and link:
                when = _first(entry, ("pubdate", "published", "updated", "date"))
                out.append((title[:TITLE_CHARS], urljoin(base or "", link), when, _plain(_summary(entry))[:SUMMARY_CHARS]))
    return out


def feed_items(feeds: DataFrame) -> DataFrame:
    """(source, pos, title, url, date, summary) of feeds(source, base_url, xml)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(s, k, *x) for s, b, xml in zip(df["source"], df["base_url"], df["xml"], strict=True) for k, x in enumerate(parse_feed(xml, b))]
            yield pd.DataFrame(rows, columns=["source", "pos", "title", "url", "date", "summary"])

    schema = "source string, pos int, title string, url string, date string, summary string"
    return feeds.select("source", "base_url", "xml").mapInPandas(run, schema).withColumn("date", norm_date(F.col("date")))


def api_items(lists: DataFrame, json_col: str = "json") -> DataFrame:
    """The articles of JSON lists(source, json): rows without an address are dropped, bad JSON has none."""
    each = lists.select("source", F.posexplode(F.from_json(json_col, API_SCHEMA)).alias("pos", "x"))
    return each.where(F.coalesce("x.url", F.lit("")) != "").select("source", "pos", "x.title", "x.url", F.substring("x.published_at", 1, 10).alias("date"), F.col("x.description").alias("summary"), F.lit("en").alias("lang"), F.col("x.user.name").alias("author"), F.col("x.id").alias("api_id"), F.col("x.tag_list").alias("tags"))


def first_items(items: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first items of each source; limit <= 0 keeps all."""
    if limit <= 0:
        return items
    return items.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("_n") <= limit).drop("_n")
