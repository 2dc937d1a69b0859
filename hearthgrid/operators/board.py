"""What boards and alerts need of a listing: requirements, alerts, scope, flags, phrases, formats, and a run's statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, folded, host_in, unaccent, url_host

#: Classes of rejection that put a listing outside the market.
OUTSIDE_MARKET = ("portal", "operacion", "tipo", "zona")


@dataclass(frozen=True)
class Requirements:
    """Limits of a profile; None asks for nothing. ``strict_area``: the least area itself isn't enough."""

    excluded_hosts: tuple[str, ...] = ()
    excluded_operations: tuple[str, ...] = ("venta", "temporada", "pieza")
    types: tuple[str, ...] = ()
    area: float | None = None
    area_tolerance: float = 0.0
    strict_area: bool = False
    bedrooms: float | None = None
    bedroom_tolerance: float = 0.0
    count_service_room: bool = False
    age: float | None = None
    price: float | None = None


def requirement_rules(req: Requirements, url: Column, operation: Column, kind: Column, area: Column, bedrooms: Column, service_room: Column, age: Column, price: Column) -> list[tuple[str, Column]]:
    """Rules for ``scoring.first_violation``, in the order in which they're told. An unknown value breaks none.

    ``area`` is the total area; a useful area says nothing against a listing. ``price`` is what's compared with the ceiling.
    """
    rules = []
    if req.excluded_hosts:
        rules.append(("portal", host_in(url_host(url), list(req.excluded_hosts))))
    if req.excluded_operations:
        rules.append(("operacion", operation.isin(list(req.excluded_operations))))
    if req.types:
        rules.append(("tipo", (kind != "") & ~fold(kind).isin([folded(t) for t in req.types])))
    if req.area is not None:
        floor = req.area - req.area_tolerance
        rules.append(("superficie", (area <= floor) if req.strict_area else (area < floor)))
    if req.bedrooms is not None:
        counted = bedrooms + F.when(service_room, 1).otherwise(0) if req.count_service_room else bedrooms
        rules.append(("dormitorios", counted < req.bedrooms - req.bedroom_tolerance))
    if req.age is not None:
        rules.append(("antiguedad", age > req.age))
    if req.price is not None:
        rules.append(("precio", price > req.price))
    return rules


def should_alert(discarded: Column, score: Column, measurable: Column, ceiling: Column, year_known: Column, least: int = 35, without_year: bool = True, incomplete: bool = True) -> Column:
    """Not discarded, its year known where that's asked for, and a score of ``least``, or, not fully measured, a ceiling of it."""
    reaches = score >= least
    if incomplete:
        reaches = reaches | ((measurable < 100) & (ceiling >= least))
    known = F.lit(True) if without_year else F.coalesce(year_known, F.lit(False))
    return ~F.coalesce(discarded, F.lit(False)) & known & F.coalesce(reaches, F.lit(False))


def in_market(rejected_as: Column) -> Column:
    """A listing that isn't rejected, or for its price or size only, still is part of the market."""
    return ~F.coalesce(rejected_as, F.lit("")).isin(list(OUTSIDE_MARKET))


def reference_area(total: Column, useful: Column) -> Column:
    return F.coalesce(total, useful)


def days_published(published: Column, as_of: Column) -> Column:
    """Whole days; a text that doesn't start with a date is unknown."""
    return F.date_diff(as_of, F.try_to_date(F.left(published.cast("string"), F.lit(10)), "yyyy-MM-dd"))


def board_flags(first_seen: Column, new_in_run: Column, last_change: Column, first_price: Column, last_price: Column, published: Column, now: Column) -> dict[str, Column]:
    """is_new (within 24 hours, or of this run), dropped (a last price below the first, at most a day old) and days (since first
    seen, else since published)."""
    seconds = now.cast("long") - first_seen.cast("long")
    return {
        "is_new": F.coalesce(new_in_run, F.lit(False)) | F.coalesce(seconds <= 86_400, F.lit(False)),
        "dropped": F.coalesce((last_price < first_price) & (F.date_diff(now, last_change) <= 1), F.lit(False)),
        "days": F.coalesce(F.greatest(F.lit(0), F.floor(seconds / 86_400)).cast("int") + F.when(first_seen.isNull(), None).otherwise(0), days_published(published, now)),
    }


def pesos(c: Column) -> Column:
    """$1.234.567, or a dash for an unknown value."""
    return F.when(c.isNull(), "—").otherwise(F.concat(F.lit("$"), F.translate(F.format_number(F.bround(c), 0), ",", ".")))


def plain_number(c: Column, suffix: str = "") -> Column:
    """1.234,5: points for thousands, a comma for at most two decimals, no trailing zeros; a dash for an unknown value."""
    text = F.translate(F.format_number(c, 2), ",.", ".,")
    return F.when(c.isNull(), "—").otherwise(F.concat(F.regexp_replace(F.regexp_replace(text, "(,[0-9]*?)0+$", "$1"), ",$", ""), F.lit(suffix)))


def returned_phrase(before: Column, old_price: Column, price: Column, as_of: Column) -> Column:
    """How many months ago the same home was listed, and what it asked if that differs; empty below thirty days."""
    days = F.date_diff(as_of, before)
    pct = F.bround(100 * (price - old_price) / old_price).cast("int")
    moved = F.when((old_price != 0) & (price != 0) & (old_price != price), F.concat(F.lit(", a "), pesos(old_price), F.format_string(" (%+d%%)", pct))).otherwise("")
    return F.when(days >= 30, F.concat(F.lit("Ya estuvo publicado hace "), F.floor(days / 30).cast("string"), F.lit(" mes(es)"), moved)).otherwise("")


#: Fixed value: the broker's code behind the word for it.
CODE_PATTERN = r"\bc[oó]d(?:igo)?\b\.?\s*[:#°-]?\s*([A-Z]{0,4}[-\s]?\d[\d.]{2,10}(?:-\w{1,4})?)"


def listing_code(c: Column) -> Column:
    """The broker's own code behind the word for it, without points, spaces and hyphens; null below four digits."""
    code = F.upper(F.regexp_replace(F.regexp_extract(c, f"(?iU){CODE_PATTERN}", 1), r"[.\s-]", ""))
    return F.when(F.length(F.regexp_replace(code, "[^0-9]", "")) >= 4, code)


def demo_order(discarded: str, score: str, key: str) -> list[Column]:
    """Kept ones first, the best first; ``key`` breaks ties."""
    return [F.asc(discarded), F.desc(score), F.asc(key)]


def run_statistics(found: DataFrame, catalog: DataFrame, before: DataFrame, source: str) -> DataFrame:
    """(source, n, silent, went_silent) for every source of the catalog: rows of this run, whether it gave none, and whether it
    did in the state before."""
    n = found.groupBy(source).agg(F.count("*").alias("n"))
    had = before.select(source).distinct().withColumn("_had", F.lit(True))
    out = catalog.select(source).distinct().join(n, source, "left").join(had, source, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(source, "n", (F.col("n") == 0).alias("silent"), ((F.col("n") == 0) & F.coalesce("_had", F.lit(False))).alias("went_silent"))
