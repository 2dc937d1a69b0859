"""Prices and links that a page states as microdata, laid beside its listings by position."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts
from ..functions.text import canonical_url, locale_number

#: Item types that wrap a listing, the outermost first.
TYPES = ("Product", "Residence", "Apartment", "Offer")
#: Path parts of a site's own pages and of lists of other homes, and marks of a filter.
SITE_PARTS = (
    "login", "ingresar", "registro", "contacto", "contactanos", "contactenos", "terminos", "privacidad", "nosotros", "blog", "faq", "ayuda", "planes", "precios", "publicar", "suscripcion", "suscribirse",
    "venta", "comprar", "todos_los_tipos", "venta_y_arriendo", "todas_las_comunas",
)
FILTER_MARKS = ("applied_filter_id", "applied_value_id")


def leads_to_no_listing(link: str) -> bool:
    """A place in the page, a script, a mail or phone, or one of the site's own pages and lists."""
    low = link.strip().lower()
    parts = re.split(r"[?#]", low)[0].split("/")[1:]
    return low.startswith(("#", "javascript:", "mailto:", "tel:")) or bool(set(parts) & set(SITE_PARTS)) or any(m in low for m in FILTER_MARKS) or any(re.fullmatch(r"(?:sin|[0-9]+|mas-de-[0-9]+)-dormitorios?", p) for p in parts)


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ITEMS = "page_id long, type string, pos int, link string, price string"


class _Items(HTMLParser):
    """Items of TYPES in page order, each with the first link and the first price inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.open = [], []  # open: (tag, item or None, price text being read or None)

    def _inside(self) -> list[dict]:
        return [item for _, item, _ in self.open if item is not None]

    def handle_starttag(self, tag, attrs):
        said = {k: v or "" for k, v in attrs}
        kind = said.get("itemtype", "").strip().rstrip("/")
        if tag == "a" and said.get("href"):
            for item in self._inside():
                item.setdefault("link", said["href"])
        text = None
        if said.get("itemprop") == "price":
            waiting = [item for item in self._inside() if "price" not in item]
            if said.get("content"):
                for item in waiting:
                    item["price"] = said["content"]
            elif tag not in _VOID:
                text = []
                for item in waiting:
                    item["price"] = text
        item = None
        if found := next((t for t in TYPES if kind.endswith(t)), None):
            item = {"type": found}
            self.items.append(item)
        if tag not in _VOID:
            self.open.append((tag, item, text))

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        for _, _, text in self.open:
            if text is not None:
                text.append(data)


def items_of(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    out = []
    for item in parser.items:
        price = item.get("price")
        if price is not None:
            out.append({"type": item["type"], "link": item.get("link"), "price": (price if isinstance(price, str) else " ".join(price)).strip()})
    return out


def page_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, type, pos, link, price) of a page's items that hold a price; pos counts within a type."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b["page_id"], b["html"], strict=True):
                seen: dict[str, int] = {}
                for item in items_of(html):
                    rows.append({"page_id": page, "pos": seen.setdefault(item["type"], 0)} | item)
                    seen[item["type"]] += 1
            yield pd.DataFrame(rows, columns=["page_id", "type", "pos", "link", "price"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).where("page_id is not null").mapInPandas(run, _ITEMS)


def by_magnitude(value: Column, in_uf: Column) -> dict[str, Column]:
    """price, price_uf and sale_uf of a number. Where the source is known to mislabel UF as pesos its size tells: a rent in UF, a rent
    in pesos, or, between the two, a sale in UF; elsewhere it is pesos or nothing."""
    rent, uf = value.between(*amounts.RENT), value.between(*amounts.RENT_UF)
    return {"price": F.when(rent, value), "price_uf": F.when(in_uf & uf, value), "sale_uf": F.when(in_uf & (value > amounts.RENT_UF[1]) & (value < amounts.RENT[0]), value)}


def fill_by_microdata(rows: DataFrame, pages: DataFrame, rate: float = amounts.RATE, page: str = "page_id", pos: str = "pos", url: str = "url", base: str = "base", price: str = "price", price_uf: str = "price_uf", direct: str = "direct", in_uf: str = "in_uf") -> DataFrame:
    """Rows with unknown prices, and links where they have none of their own, filled from the page's items in the same order; adds
    ``operation`` (``venta`` where the price shows a sale).

    Only an outermost type with exactly one item for each of the page's rows is laid beside them, so nothing can be out of step.
    Defined results: a page without such a type, and a row that knows its price and link, stay as they are; a link to the page itself
    or to no listing isn't taken; an unreadable price fills nothing; no row is added or lost.
    """
    place = F.row_number().over(Window.partitionBy(page).orderBy(pos)) - 1  # a page holds a bounded number of rows
    named = rows.withColumn("_pos", place)
    wanted = rows.groupBy(F.col(page).alias("page_id")).agg(F.count("*").alias("_n"))
    items = page_items(pages)
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    fitting = items.groupBy("page_id", "type").agg(F.count("*").alias("_k")).join(wanted, "page_id").where("_k = _n")
    chosen = fitting.groupBy("page_id").agg(F.min_by("type", rank).alias("type"))
    side = items.join(chosen, ["page_id", "type"]).select(F.col("page_id").alias("_page"), F.col("pos").alias("_pos"), "link", F.col("price").alias("_stated"))
    out = named.withColumn("_page", F.col(page).cast("long")).join(side, ["_page", "_pos"], "left")

    @F.pandas_udf("string")
    def absolute(links: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([None if link is None or leads_to_no_listing(link) else urljoin(b or "", link) for link, b in zip(links, bases, strict=True)], dtype=object)

    out = out.withColumn("_link", F.when(~F.coalesce(F.col(direct), F.lit(False)), absolute(F.col("link"), F.col(base))))
    out = out.withColumn("_link", F.when(canonical_url(F.col("_link")) != canonical_url(F.col(base)), F.col("_link")))
    number = F.coalesce(locale_number(F.regexp_replace("_stated", r"[^0-9.,]", "")), F.lit(0.0))
    said = by_magnitude(F.when(F.col(price).isNull() & F.col(price_uf).isNull() & (number > 0), number), F.coalesce(F.col(in_uf), F.lit(False)))
    out = out.withColumns({f"_{k}": v for k, v in said.items()})
    value = {url: F.coalesce("_link", url), direct: F.when(F.col("_link").isNotNull(), True).otherwise(F.col(direct)), price: F.coalesce(price, "_price", F.bround(F.col("_price_uf") * rate)), price_uf: F.coalesce(price_uf, "_price_uf")}
    return out.select(*[value.get(c, F.col(c)).alias(c) for c in rows.columns], F.when(F.col("_sale_uf").isNotNull(), "venta").alias("operation"))
