"""Completing listings from their own detail pages: which of a page's readings speak of the listing, and what is taken from them.

A page comes as rows that were extracted from it (``candidates``), one reading of its text, and a map pin. Candidates are
reduced to one row for each page by aggregates that combine before the shuffle, so a page of any number of similar
homes costs one row in the join, and listings that need nothing, or have no page of their own, never enter it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url, fold


@dataclass(frozen=True)
class Reading:
    """Names of columns. ``fields``: those that may be filled; ``price``: taken together, and only where the listing has none of
    them; ``place`` is compared folded, ``counts`` as they are; ``year``: all that a page that may be another's is believed in;
    ``wanted``: a listing that knows all of these (beside its price) isn't looked up; ``pin``: filled from the map first."""

    fields: tuple[str, ...]
    price: tuple[str, ...] = ("price", "price_uf")
    place: str = "place"
    counts: tuple[str, ...] = ("bedrooms", "baths")
    year: tuple[str, ...] = ("age", "built")
    wanted: tuple[str, ...] = ("age", "fees", "total", "floor", "bedrooms", "baths", "lat", "address")
    pin: tuple[str, str] = ("lat", "lon")
    #: So many candidates make a page a list of homes, whose text is nobody's.
    list_page: int = 5


def known(df: DataFrame, c: str, at: str | None = None) -> Column:
    """The column, null where it's blank; ``at``: the struct that holds it."""
    value = F.col(f"{at}.{c}") if at else F.col(c)
    return F.nullif(F.trim(value), F.lit("")) if df.schema[c].dataType.typeName() == "string" else value


def _positive(columns: tuple[str, ...], prefix: str = "") -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(f"{prefix}{c}") > 0, F.lit(False))
    return out


def priced(price: tuple[str, ...]) -> Column:
    """Struct of the prices, null where none is known and above zero."""
    return F.when(_positive(price), F.struct(*price))


def page_candidates(candidates: DataFrame, r: Reading, page: str = "page_url", url: str = "url", order: str = "pos") -> DataFrame:
    """One row for each page (``_page``): ``n`` candidates, ``n_own`` that lead to the page itself, what the own ones say of each
    field (the first that knows it) and of the price, and the same of a lone candidate."""
    c = candidates.withColumn("_page", canonical_url(F.col(page)))
    own = F.coalesce((F.col("_page") != "") & (canonical_url(F.col(url)) == F.col("_page")), F.lit(False))
    at = F.col(order)
    first = lambda value, when: F.min_by(value, F.when(when & value.isNotNull(), at))
    both = [F.struct(*[first(known(candidates, f), when).alias(f) for f in r.fields]).alias(name) for name, when in (("own", own), ("lone", F.lit(True)))]
    prices = [first(priced(r.price), when).alias(name) for name, when in (("own_price", own), ("lone_price", F.lit(True)))]
    return c.where("_page is not null").groupBy("_page").agg(F.count("*").alias("n"), F.count_if(own).alias("n_own"), *both, *prices)


def _same_text(a: Column, b: Column) -> Column:
    return fold(a) == fold(b)


def _disputes(listings: DataFrame, r: Reading, side: str) -> dict[str, Column]:
    """For each field that can contradict: whether both know it and differ."""
    out = {c: F.col(c) != F.col(f"{side}.{c}") for c in r.counts if c in r.fields}
    if r.place in r.fields:
        out[r.place] = ~_same_text(known(listings, r.place), F.nullif(F.trim(F.col(f"{side}.{r.place}")), F.lit("")))
    return {c: F.coalesce(x, F.lit(False)) for c, x in out.items()}


def _any(parts: dict[str, Column]) -> Column:
    out = F.lit(False)
    for x in parts.values():
        out = out | x
    return out


def enrich(listings: DataFrame, candidates: DataFrame, texts: DataFrame, pins: DataFrame, r: Reading, url: str = "url", direct: str = "direct") -> DataFrame:
    """The listings with unknown fields filled, ``enriched``, and ``origin``: from field to pin, own or text.

    ``texts``: (page_url, anchored, fields, price), one reading for each page; ``pins``: (page_url, lat, lon). Candidates that
    lead to the page itself are the listing's own; where there is none, a page's lone candidate is, unless it contradicts what
    the listing knows. Of a text that contradicts, only the contradicting fields are dropped if an own candidate or the
    anchor shows that the page is the listing's, else all of it. A text with neither is believed in the year alone.

    Defined results: a listing without a url, without a page or not ``direct`` stays as it is; blank texts are unknown, and stay if
    nothing is found; of
    several texts or pins of one page the first in order of their values counts; repeated listings are each completed; no row
    is added or lost.
    """
    unknown = _any({c: known(listings, c).isNull() for c in r.wanted if c in listings.columns}) | priced(r.price).isNull()
    part = F.coalesce(F.col(direct) & unknown & (canonical_url(F.col(url)) != ""), F.lit(False))
    asks = listings.where(part).withColumn("_page", canonical_url(F.col(url)))
    rest = listings.where(~part)
    on_page = lambda df: df.withColumn("_page", canonical_url(F.col("page_url"))).where("_page is not null")
    said = on_page(texts).groupBy("_page").agg(F.min(F.struct("anchored", *r.fields, *r.price)).alias("text"))
    pinned = on_page(pins).where(" and ".join(f"{c} is not null" for c in r.pin)).groupBy("_page").agg(F.min(F.struct(*r.pin)).alias("pin"))
    page = page_candidates(candidates, r)
    j = asks.join(page, "_page", "left").join(said, "_page", "left").join(pinned, "_page", "left")
    lone = (F.col("n_own") == 0) & (F.col("n") == 1) & ~_any(_disputes(listings, r, "lone"))
    j = j.withColumn("_mine", F.when(F.col("n_own") > 0, F.struct(F.col("own").alias("f"), F.col("own_price").alias("p"))).when(lone, F.struct(F.col("lone").alias("f"), F.col("lone_price").alias("p"))))
    has_own, anchored = F.col("_mine").isNotNull(), F.coalesce("text.anchored", F.lit(False))
    clash = _disputes(listings, r, "text")
    usable = F.col("text").isNotNull() & (F.coalesce("n", F.lit(0)) < r.list_page) & (has_own | anchored | ~_any(clash))
    whole = has_own | anchored
    value = lambda c: F.when(usable & ~clash.get(c, F.lit(False)) & (F.lit(c in r.year) | whole), known(listings, c, "text"))
    j = j.withColumn("_said", F.struct(*[value(c).alias(c) for c in r.fields]))
    year = F.coalesce(*[F.col(f"_said.{c}").cast("string") for c in r.year if c in r.fields], F.lit(None).cast("string"))
    text_price = F.when(usable & whole & _positive(r.price, "text."), F.struct(*[F.col(f"text.{c}").alias(c) for c in r.price]))
    has_text = usable & (whole | year.isNotNull())
    j = j.withColumns({"_has_own": has_own, "_has_text": has_text, "_no_price": priced(r.price).isNull()})
    j = j.withColumn("_price", F.when(F.col("_no_price"), F.coalesce("_mine.p", text_price)))
    out, origin = {}, []
    for c in [*r.fields, *[x for x in r.pin if x not in r.fields]]:
        steps = [("pin", F.col(f"pin.{c}"))] if c in r.pin else []
        # a pin counts for a listing without a place on the map only, and as a pair
        steps = [(k, F.when(F.col(r.pin[0]).isNull(), x)) for k, x in steps]
        if c in r.fields:
            steps += [("own", F.col(f"_mine.f.{c}")), ("text", F.col(f"_said.{c}"))]
        out[c] = F.coalesce(known(listings, c), *[x for _, x in steps], F.col(c))
        origin.append(F.when(known(listings, c).isNull(), F.coalesce(*[F.when(x.isNotNull(), F.lit(k)) for k, x in steps])).alias(c))
    for c in r.price:
        out[c] = F.when(F.col("_price").isNotNull(), F.col(f"_price.{c}")).otherwise(F.col(c))
        origin.append(F.when(F.col("_price").isNotNull() & F.col(f"_price.{c}").isNotNull(), F.when(F.col("_mine.p").isNotNull(), "own").otherwise("text")).alias(c))
    told = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in [*out]]), F.array(*origin)), lambda _, v: v.isNotNull())
    j = j.withColumn("origin", told).withColumn("enriched", F.col("_has_own") | F.col("_has_text"))
    done = j.select(*[(out[c] if c in out else F.col(c)).alias(c) for c in listings.columns], "enriched", "origin")
    return done.unionByName(rest.withColumn("enriched", F.lit(False)).withColumn("origin", F.create_map().cast("map<string,string>")))

