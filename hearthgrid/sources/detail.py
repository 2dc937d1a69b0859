"""Reading a detail page by its text: where the listing's own section starts, and what the header before it says."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import amounts
from ..functions.text import area_texts, areas_of, building_age_of, building_age_texts, canonical_url, floor_and_unit_of, floor_texts, fold, map_pin, programme_of

#: Characters of a title or address that are looked for, the fewest that anchor, and those of the header, of the body and of a page
#: worth reading.
ANCHOR, LEAST_ANCHOR, HEADER, BODY, LEAST = 40, 12, 3_000, 20_000, 40
#: What a page's text is believed in; of identity nothing.
FIELDS = ("price", "fees", "built", "age", "total", "useful", "terrace", "bedrooms", "baths", "parking", "storage", "floor")


class _Text(HTMLParser):
    """Text outside script, style and noscript, with a space where markup was."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style", "noscript")))

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible_parts(html: str) -> list[str]:
    """Pieces of text between markup, in page order."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return parser.parts


def visible(html: str | None) -> str | None:
    return None if html is None else re.sub(r"\s+", " ", " ".join(visible_parts(html))).strip()


def visible_text(html: Column) -> Column:
    """The page's text on one line.

    It's marked as nondeterministic so that a filter on the text isn't moved below, where each page would be parsed twice.
    """

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(visible, na_action="ignore")

    return run.asNondeterministic()(html)


def _anchor(c: Column) -> Column:
    short = F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(ANCHOR))
    return F.when(F.length(short) >= LEAST_ANCHOR, F.lower(short))


def sections(text: Column, title: Column, address: Column) -> dict[str, Column]:
    """anchored, header and body of a text: cut at the title, or else at the address up to its first comma, where one stands in it.

    The header is what lies right before that place. A page without either has no header and is all body.
    """
    low = F.lower(text)
    place = [F.nullif(F.coalesce(F.position(_anchor(a), low), F.lit(0)), F.lit(0)) for a in (title, F.split_part(address, F.lit(","), F.lit(1)))]
    start = F.coalesce(*place)
    header = F.right(F.left(text, F.coalesce(start, F.lit(1)) - 1), F.lit(HEADER))
    return {"anchored": start.isNotNull(), "header": F.when(F.length(header) >= LEAST, header), "body": F.left(F.substr(text, F.coalesce(start, F.lit(1))), F.lit(BODY))}


def _texts(folded: Column) -> dict[str, Column]:
    """What stands in a folded section where its areas, age and floor do."""
    return area_texts(folded) | building_age_texts(folded) | floor_texts(folded)


def _said(folded: Column, texts: dict[str, Column], found: Column, as_of: Column) -> dict[str, Column]:
    """Fields of a section; of money only what has a label."""
    size, rooms, age, floor = areas_of(texts), programme_of(folded), building_age_of(texts, as_of), floor_and_unit_of(texts)
    said = amounts.labelled_money(found)
    return {"price": said["rent"], "fees": said["fees"], "built": age["built"], "age": age["age"], **{k: size[k] for k in ("total", "useful", "terrace")}, **{k: rooms[k] for k in ("bedrooms", "baths", "parking", "storage")}, "floor": floor["floor"]}


def text_readings(pages: DataFrame, listings: DataFrame, as_of: Column, page_url: str = "page_url", html: str = "html", url: str = "url", title: str = "title", address: str = "address") -> DataFrame:
    """(page_url, anchored, fields) of each page that is a listing's own: what its text says from the listing's title or address
    on, except where the header before it says something else.

    The header is a sheet of labelled facts and the body is prose, so the header wins. A page with little text has no row.
    """
    own = listings.select(canonical_url(F.col(url)).alias("_page"), F.col(title).alias("_title"), F.col(address).alias("_address")).where("_page <> ''")
    own = own.groupBy("_page").agg(F.min(F.struct("_title", "_address")).alias("_l"))
    # a page costs much more to read than its bytes tell, so pages are dealt by number, and no side of the join is sent to the driver
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = pages.select(F.col(page_url).alias("page_url"), canonical_url(F.col(page_url)).alias("_page"), F.col(html).alias("_html"))
    p = p.where("_page <> ''").repartition(n, "_page").join(own.hint("merge"), "_page")
    p = p.withColumn("_text", visible_text(F.col("_html"))).where(F.length("_text") >= LEAST)
    p = p.withColumns(sections(F.col("_text"), F.col("_l._title"), F.col("_l._address"))).select("page_url", "anchored", "header", "body")
    # columns of their own at each step: what is put into an expression in several places is worked out as often
    both = lambda of: {f"_{k}_{name}": c for k in ("header", "body") for name, c in of(k).items()}
    p = p.withColumns(both(lambda k: {"amounts": amounts.read_amounts(F.col(k)), "folded": fold(F.col(k))}))
    p = p.withColumns(both(lambda k: {f"text_{name}": c for name, c in _texts(F.col(f"_{k}_folded")).items()}))
    at = lambda k: {name: F.col(f"_{k}_text_{name}") for name in _texts(F.lit(""))}
    p = p.withColumns(both(lambda k: _said(F.col(f"_{k}_folded"), at(k), F.col(f"_{k}_amounts"), as_of)))
    # zero in the header is no news
    news = lambda c: F.col(f"_header_{c}") if c == "storage" else F.when(F.col(f"_header_{c}") != 0, F.col(f"_header_{c}"))
    return p.select("page_url", "anchored", *[F.coalesce(news(c), F.col(f"_body_{c}")).alias(c) for c in FIELDS])


def page_pins(pages: DataFrame, page_url: str = "page_url", html: str = "html") -> DataFrame:
    """(page_url, lat, lon) of the pages with a pin on a map."""
    p = pages.select(F.col(page_url).alias("page_url"), map_pin(F.col(html)).alias("_p")).where("_p is not null")
    return p.select("page_url", "_p.lat", "_p.lon")
