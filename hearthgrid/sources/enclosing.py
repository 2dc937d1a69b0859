"""Prices that a page prints beside the link to a listing: the page's tree as intervals, climbed from the link outwards.

Each element spans from the count at which it opens to that at which it closes, so what lies in a block is what opens within its
span. A block that holds the link of another listing isn't the listing's card any more, and neither is anything around it; where
the nearest such links are comes from one window over a page's links, not from comparing blocks with links.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts

#: Blocks that are climbed from a link, characters of the largest, and of the shortest path that names a listing.
CLIMB, LARGEST, LEAST_PATH = 4, 600, 8
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style"))
_LINKS = "page_id long, opens int, path string, blocks array<struct<opens int, closes int, chars int, text string>>"


class _Tree(HTMLParser):
    """Elements as [tag, opens, closes, first word, end of words] and the links with their enclosing elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at, self.words, self.open, self.links, self.hidden = 0, [], [], [], 0

    def handle_starttag(self, tag, attrs):
        self.at += 1
        element = [tag, self.at, None, len(self.words), None]
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append((self.at, href, self.open[: -CLIMB - 1 : -1]))
        if tag in _VOID:
            return
        self.hidden += tag in _HIDDEN
        self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _shut(self):
        element = self.open.pop()
        self.at += 1
        self.hidden -= element[0] in _HIDDEN
        element[2], element[4] = self.at, len(self.words)

    def handle_endtag(self, tag):
        if any(e[0] == tag for e in self.open):
            while self.open[-1][0] != tag:
                self._shut()
            self._shut()

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()

    def close(self):
        super().close()
        while self.open:
            self._shut()


def path_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").path.rstrip("/")
    except ValueError:
        return ""


def links_of(html: str | None) -> list[dict]:
    """Links in page order with up to CLIMB enclosing blocks, nearest first; a block's text only if it is short enough."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    texts: dict[int, tuple[int, str | None]] = {}

    def text(e: list) -> tuple[int, str | None]:
        if e[1] not in texts:
            size = sum(map(len, tree.words[e[3] : e[4]])) + max(0, e[4] - e[3] - 1)
            texts[e[1]] = size, " ".join(tree.words[e[3] : e[4]]) if size <= LARGEST else None
        return texts[e[1]]

    return [{"opens": at, "path": path_of(href), "blocks": [dict(zip(("opens", "closes", "chars", "text"), (e[1], e[2], *text(e)), strict=True)) for e in around]} for at, href, around in tree.links]


def page_link_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, opens, path, blocks) of every link with a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"page_id": page} | link for page, html in zip(b["page_id"], b["html"], strict=True) for link in links_of(html) if link["path"]]
            yield pd.DataFrame(rows, columns=["page_id", "opens", "path", "blocks"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).where("page_id is not null").mapInPandas(run, _LINKS)


def url_path(c: Column) -> Column:
    """Path of an absolute url as it stands."""
    return F.regexp_extract(F.split_part(F.split_part(c, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(.*)$", 1)


def fill_by_enclosing_link(rows: DataFrame, pages: DataFrame, page: str = "page_id", key: str = "pos", url: str = "url", base: str = "base", price: str = "price", fees: str = "fees") -> DataFrame:
    """Rows without a price take it, and unknown fees, from the nearest block around the first link to them that states one.

    ``base``: the page's own url, which names no listing. Climbing ends at a block of more than LARGEST characters or with a link to
    another of the page's rows.

    Defined results: a row with a price, without a url, with the page's own url or a path below LEAST_PATH characters stays as it is;
    so does one that no link of the page leads to by its whole path; rows that share a url share what is found; no row is added or
    lost; fees come only together with a price.
    """
    path = F.rtrim(url_path(F.col(url)), F.lit("/"))
    asks = F.col(price).isNull() & (F.col(url) != F.col(base)) & (F.length(url_path(F.col(url))) >= LEAST_PATH)
    named = rows.withColumns({"_page": F.col(page).cast("long"), "_path": path, "_asks": asks})
    # rows and links grow alike and nothing here says how large they are, so no side of a join is sent to the driver
    routes = named.where("_path <> ''").groupBy(F.col("_page").alias("page_id"), F.col("_path").alias("path")).agg(F.bool_or("_asks").alias("_asks"))
    links = page_link_blocks(pages).join(routes.hint("merge"), ["page_id", "path"])
    order = Window.partitionBy("page_id").orderBy("opens")
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    links = links.withColumns({"_b": F.lag("path").over(order), "_a": F.lead("path").over(order), "_bo": F.lag("opens").over(order), "_ao": F.lead("opens").over(order)})
    other = {"before": F.last(F.when(F.col("_b") != F.col("path"), F.col("_bo")), ignorenulls=True).over(order), "after": F.first(F.when(F.col("_a") != F.col("path"), F.col("_ao")), ignorenulls=True).over(after)}
    firsts = links.withColumns(other).where("_asks").groupBy("page_id", "path").agg(F.min_by(F.struct("before", "after", "blocks"), "opens").alias("_l"))
    climbed = firsts.select("page_id", "path", "_l.before", "_l.after", F.posexplode("_l.blocks").alias("level", "_x"))
    over = (F.col("_x.chars") > LARGEST) | F.coalesce(F.col("before") > F.col("_x.opens"), F.lit(False)) | F.coalesce(F.col("after") < F.col("_x.closes"), F.lit(False))
    # a block lies in the next, so what ends the climb at one level ends it at all above
    read = climbed.where(~over).withColumn("_found", amounts.read_amounts(F.col("_x.text")))
    said = amounts.money(F.col("_found"))
    read = read.withColumns({"_rent": said["rent"], "_common": said["fees"]})
    # a filter on the rent would be moved below what reads the texts, which then reads them twice
    best = read.groupBy("page_id", "path").agg(F.min_by(F.struct("_rent", "_common"), F.when(F.col("_rent").isNotNull(), F.col("level"))).alias("_got"))
    best = best.select(F.col("page_id").alias("_page"), F.col("path").alias("_path"), "_got")
    out = named.join(best.hint("merge"), ["_page", "_path"], "left")
    found = {price: F.when(F.col("_asks"), F.col("_got._rent")), fees: F.when(F.col("_asks"), F.col("_got._common"))}
    return out.select(*[F.coalesce(F.col(c), found[c]).alias(c) if c in found else F.col(c) for c in rows.columns])
