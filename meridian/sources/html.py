"""Markup to rows: title, text, links and images of pages, in workers, with the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELLS = {"li", "td", "th", "dt", "dd", "tr"}
_SILENT = {"script", "style", "noscript", "template"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "td", "th"}


class _Page(HTMLParser):
    """Collects what a page holds; unclosed and crossed tags are taken as they come."""

    def __init__(self, base: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.text = base, "", []
        self.links: list[list] = []
        self.images: list[tuple[str, str, int, int, int]] = []
        self._silent, self._in_title, self._open, self._count, self._cell, self._cells = 0, False, None, 0, 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        self._count += 1
        if tag in _CELLS:  # a new item or cell ends the one before, closed or not
            self._cells += 1
            self._cell = self._cells
        if tag in _SILENT:
            self._silent += 1
        elif tag == "title":
            self._in_title = True
        elif tag == "a" and given.get("href"):
            self._open = [urldefrag(urljoin(self.base, given["href"].strip()))[0], "", self._count, self._cell]
            self.links.append(self._open)
        elif tag == "img" and given.get("src"):
            side = [int(m[0]) if (m := re.search(r"\d+", given.get(k, ""))) else 0 for k in ("width", "height")]
            self.images.append((urljoin(self.base, given["src"].strip()), given.get("alt", ""), self._count, self._cell, side[0] * side[1]))
        if tag in _BLOCKS:
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _CELLS or tag in ("ul", "ol", "dl", "table"):
            self._cell = 0
        if tag in _SILENT:
            self._silent = max(0, self._silent - 1)
        elif tag == "title":
            self._in_title = False
        elif tag == "a":
            self._open = None

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title += data
        elif not self._silent:
            self.text.append(data)
            if self._open is not None:
                self._open[1] += data


def parse_page(html: str, base: str) -> dict:
    """title, text, links (url, text, position, cell) and images (url, alt, position, cell, area) of a page.

    Cells are numbered as items and table cells open, 0 outside them; area is that of the declared width and height, 0 without.
    """
    page = _Page(base)
    page.feed(html)
    page.close()
    squeeze = lambda t: " ".join(t.split())
    lines = [squeeze(x) for x in "".join(page.text).split("\n")]
    return {
        "title": squeeze(page.title), "text": "\n".join(x for x in lines if x), "links": [{"url": u, "text": squeeze(t), "position": p, "cell": c} for u, t, p, c in page.links],
        "images": [{"url": u, "alt": squeeze(a), "position": p, "cell": c, "area": n} for u, a, p, c, n in page.images],
    }


def parse_pages(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(url, title, text, links, images) of every page; a null page has nulls and empty lists."""
    shape = "url string, title string, text string, links array<struct<url:string,text:string,position:int,cell:int>>, images array<struct<url:string,alt:string,position:int,cell:int,area:int>>"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"url": u} | (parse_page(h, u or "") if h is not None else {"title": None, "text": None, "links": [], "images": []}) for u, h in zip(pdf["u"], pdf["h"])]
            yield pd.DataFrame(rows, columns=["url", "title", "text", "links", "images"])

    return pages.select(F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(parse, shape)


def page_images(parsed: DataFrame, skip: str = r"(?i)/(?:nav|icons?|buttons?|logo)") -> DataFrame:
    """(url, image, alt, area) of parsed pages: each image once, its largest declared area; what serves navigation is left out."""
    rows = parsed.select("url", F.explode("images").alias("i")).where(~F.col("i.url").rlike(skip))
    best = rows.groupBy("url", F.col("i.url").alias("image")).agg(F.min(F.struct((-F.col("i.area")).alias("less"), F.col("i.position").alias("at"), F.col("i.alt").alias("alt"))).alias("b"))
    return best.select("url", "image", "b.alt", (-F.col("b.less")).alias("area"))


def beside_links(parsed: DataFrame, skip: str = r"(?i)/(?:nav|icons?|buttons?|logo)") -> DataFrame:
    """(url, link, text, image) of parsed pages: each link with the first image in its cell, or else the first one after it; null without."""
    rows = parsed.select("url", F.filter("images", lambda i: ~i["url"].rlike(skip)).alias("images"), F.explode("links").alias("l"))
    inside = F.filter("images", lambda i: (i["cell"] == F.col("l.cell")) & (i["cell"] > 0))
    after = F.filter("images", lambda i: i["position"] > F.col("l.position"))
    return rows.select("url", F.col("l.url").alias("link"), F.col("l.text").alias("text"), F.coalesce(F.get(inside, F.lit(0))["url"], F.get(after, F.lit(0))["url"]).alias("image"))
