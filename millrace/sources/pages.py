"""Fields of web pages held in a table ``(page_id, html)``. Nothing is fetched."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markup patterns, read by Java and RE2 alike ...
TITLE = r"(?s)<title>(.*?)</title>"
HEADING = r"(?s)<h1>(.*?)</h1>"
HREF = r'<a [^>]*href="([^"]*)"'
BLOCK = r'(?s)<(nav|article|div class="ad")>(.*?)</(?:nav|article|div)>'
TAG = r"<[^>]*>"
# ... and the class names of listing pages.
LISTING_CLASSES = {"title": "title", "description": "description", "city": "locale", "timestamp": "timestamp"}
LINK_CLASS = "cta"
LISTING_MARK = "locale"
# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


# The entities that every page may use; the ampersand comes last, or it would make new ones.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
# Elements that end where the next of their kind starts.
IMPLIED_END = {"li", "p", "td", "th", "tr", "option", "dt", "dd"}


def decoded(text: Column) -> Column:
    """Text with its basic entities written out."""
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def page_fields(pages: DataFrame) -> DataFrame:
    """``(page_id, title, heading)``, entities decoded."""
    return pages.select(
        "page_id",
        decoded(F.regexp_extract("html", TITLE, 1)).alias("title"),
        decoded(F.regexp_extract("html", HEADING, 1)).alias("heading"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, href)``: one row per link."""
    links = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    rows = pages.select("page_id", F.posexplode_outer(links).alias("pos", "href"))
    return rows.where(F.col("href").isNotNull())


def page_blocks(pages: DataFrame, drop: list[str] = ['div class="ad"']) -> DataFrame:
    """``(page_id, pos, region, text)``: text blocks outside the dropped regions, tags removed."""
    regions = F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(BLOCK), F.lit(2))
    blocks = F.arrays_zip(regions.alias("region"), texts.alias("text"))
    rows = pages.select("page_id", F.posexplode_outer(blocks).alias("pos", "b")).where(F.col("b").isNotNull())
    kept = rows.where(~F.col("b.region").isin(drop))
    return kept.select(
        "page_id", "pos", F.col("b.region").alias("region"), F.regexp_replace("b.text", TAG, " ").alias("text")
    )


class _Nodes(HTMLParser):
    """Open elements as dicts of class names, own text and link, children and parent."""

    def __init__(self) -> None:
        super().__init__()
        self.root = {"classes": [], "href": None, "parts": [], "parent": None}
        self.open, self.all = self.root, []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in IMPLIED_END and self.open.get("tag") == tag:
            self.open = self.open["parent"]
        node = {
            "tag": tag, "classes": (given.get("class") or "").split(), "href": given.get("href"),
            "parts": [], "parent": self.open,
        }
        self.open["parts"].append(node)
        self.all.append(node)
        if tag not in VOID:
            self.open = node

    def handle_endtag(self, tag):
        node = self.open
        while node["parent"] is not None and node.get("tag") != tag:
            node = node["parent"]
        if node["parent"] is not None:
            self.open = node["parent"]

    def handle_data(self, data):
        self.open["parts"].append(data)


def _inside(node: dict) -> Iterator[dict | str]:
    """Elements and texts inside a node in page order; a stack, as pages may be nested to any depth."""
    stack = [iter(node["parts"])]
    while stack:
        part = next(stack[-1], None)
        if part is None:
            stack.pop()
            continue
        yield part
        if isinstance(part, dict):
            stack.append(iter(part["parts"]))


def _text(node: dict) -> str:
    return "".join(p for p in _inside(node) if isinstance(p, str))


def page_listings(html: str) -> Iterator[dict]:
    """The listings of one page, with the keys of :data:`LISTING_FIELDS`."""
    nodes = _Nodes()
    nodes.feed(html)
    wanted = {*LISTING_CLASSES.values(), LINK_CLASS}
    for mark in nodes.all:
        if LISTING_MARK not in mark["classes"]:
            continue
        listing, first = mark["parent"], {}
        for part in _inside(listing):
            if isinstance(part, dict):
                for name in wanted.intersection(part["classes"]):
                    first.setdefault(name, part)
            if len(first) == len(wanted):
                break
        row = {name: _text(first[c]) if c in first else None for name, c in LISTING_CLASSES.items()}
        row["href"] = first[LINK_CLASS]["href"] if LINK_CLASS in first else None
        outer = listing["parent"]
        row["region"] = " ".join(outer["classes"]) if outer else ""
        yield row


LISTING_FIELDS = "title string, href string, city string, timestamp string, description string, region string"


def extracted(
    pages: DataFrame, extract: Callable[[str], Iterable[dict]], fields: str, page_id: str = "page_id", html: str = "html"
) -> DataFrame:
    """``(page_id, fields...)``: a row for each dict that ``extract`` makes of a page.

    The pages are handed to it in Arrow batches, in parallel with no shuffle; a NULL page is an empty one.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", *(f.strip().split(" ")[0] for f in fields.split(","))]
        for batch in batches:
            rows = [(i, *map(row.get, names[1:])) for i, text in zip(batch["page_id"], batch["html"]) for row in extract(text or "")]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    given = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"))
    return given.mapInPandas(parse, f"page_id bigint, {fields}")


def listings(pages: DataFrame, extract: Callable[[str], Iterable[dict]] = page_listings) -> DataFrame:
    """``(page_id, title, href, city, timestamp, description, region)``, one row per listing of a page.

    ``region`` holds the classes of the element around the listing. A missing part is NULL.
    """
    return extracted(pages, extract, LISTING_FIELDS)


def linked_texts(html: str) -> Iterator[dict]:
    """Links of one page with their decoded text and the tag of the region around them."""
    nodes = _Nodes()
    nodes.feed(html)
    for node in nodes.all:
        if node["tag"] == "a" and node["href"] is not None:
            yield {"href": node["href"], "label": _text(node), "region": node["parent"].get("tag")}


def outside(found: DataFrame, region: str) -> DataFrame:
    """Listings whose surrounding element does not have the class ``region``."""
    return found.where(~F.array_contains(F.split("region", " "), region))
