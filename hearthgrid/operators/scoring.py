"""Eligibility and scoring as pure columns of a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_violation(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that is known to be broken. An unknown value breaks nothing."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules], F.lit(None).cast("string"))


def in_zone(place: Column, km: Column, core: list[str], near: list[str], deduced: Column, ring: float, unknown_ring: float, foreign: Column | None = None) -> Column:
    """Core places are in; a neighbour needs no coordinates or to lie in the ring; an unknown place is in unless far away.

    A deduced place farther than ``unknown_ring`` is out, and so is an unknown place in a foreign region.
    """
    far = F.coalesce(km > unknown_ring, F.lit(False))
    unknown = place.isNull() | (place == "")
    abroad = F.lit(False) if foreign is None else F.coalesce(foreign, F.lit(False))
    return (
        F.when(~unknown & F.coalesce(deduced, F.lit(False)) & far, False)
        .when(place.isin(core), True)
        .when(unknown & abroad, False)
        .when(unknown, ~far)
        .when(place.isin(near), km.isNull() | (km <= ring))
        .otherwise(False)
    )


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between (x, y) points in order, constant outside; null stays null. Equal x make a step, the later y from there on."""
    out = F.when(x < points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        if x1 > x0:
            out = out.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(points[-1][1]))))


def location_score(km: Column, weight_of_place: Column, preferred: float, ring: float, weight: float = 26.0) -> Column:
    """Whole points: full within the preferred distance, falling by .35 to the ring, then .12 a km down to .45; .75 without coordinates."""
    factor = (
        F.when(km.isNull(), 0.75)
        .when(km <= preferred, 1.0)
        .when(km <= ring, 1 - 0.35 * (km - preferred) / max(ring - preferred, 0.01))
        .otherwise(F.greatest(F.lit(0.45), 1 - 0.12 * (km - ring)))
    )
    return F.bround(weight * weight_of_place * factor)


def price_score(price: Column, fee_pct: Column, cap: float, weight: float = 20.0, tolerance: float = 0.12) -> Column:
    """Whole points: full up to 55 % of the cap, .75 at the cap, then .55 falling by .45 for each tolerated excess down to
    nothing; fees above 20 % cost a fifth, rounded again."""
    p = price / cap
    factor = F.when(p <= 0.55, 1.0).when(p <= 1.0, 1 - 0.25 * (p - 0.55) / 0.45).otherwise(F.greatest(F.lit(0.0), 0.55 - 0.45 * (p - 1) / tolerance))
    got = F.bround(weight * factor)
    return F.when(price.isNotNull(), F.when(F.coalesce(fee_pct > 20, F.lit(False)), F.bround(got * 0.8)).otherwise(got))


def area_score(area: Column, least: float, comfortable: float, full: float = 170.0, weight: float = 16.0) -> Column:
    """Whole points: .30 below the least area, then from .55 to .85 at the comfortable one and to 1 at the full one."""
    factor = (
        F.when(area < least, 0.30)
        .when(area < comfortable, 0.55 + 0.30 * (area - least) / max(comfortable - least, 1))
        .when(area < full, 0.85 + 0.15 * (area - comfortable) / max(full - comfortable, 1))
        .otherwise(1.0)
    )
    return F.when(area.isNotNull(), F.bround(weight * factor))


def age_score(age: Column, ideal: float, good: float, acceptable: float, weight: float = 24.0) -> Column:
    """Whole points, falling from year zero: 1 to .85 at the ideal age, .65 at the good, .25 at the acceptable one, then .01 a
    year down to .10."""
    factor = (
        F.when(age <= ideal, 1 - 0.15 * age / max(ideal, 1))
        .when(age <= good, 0.85 - 0.20 * (age - ideal) / max(good - ideal, 1))
        .when(age <= acceptable, 0.65 - 0.40 * (age - good) / max(acceptable - good, 1))
        .otherwise(F.greatest(F.lit(0.10), 0.25 - 0.01 * (age - acceptable)))
    )
    return F.when(age.isNotNull(), F.bround(weight * factor))


def programme_score(bedrooms: Column, baths: Column, wanted_bedrooms: int, wanted_baths: int, weight: float = 14.0) -> Column:
    """Whole points: 60 % for bedrooms, three quarters of it at any number and the rest for up to two extra ones, and 40 % for
    baths up to the wanted number. A part that isn't known gives nothing; null if neither is."""
    extra = F.least(F.greatest(bedrooms - wanted_bedrooms, F.lit(0)), F.lit(2)) / 2
    # least and greatest pass over nulls, so what isn't known is asked for
    beds = F.when(bedrooms.isNotNull(), weight * 0.60 * (0.75 + 0.25 * extra))
    bath = F.when(baths.isNotNull(), weight * 0.40 * F.least(baths / F.lit(float(wanted_baths)), F.lit(1.0)))
    points = F.bround(F.coalesce(beds, F.lit(0.0)) + F.coalesce(bath, F.lit(0.0)))
    return F.when(bedrooms.isNotNull() | baths.isNotNull(), points)


def preference_score(terms: list[Column], low: float = -12.0, high: float = 6.0) -> Column:
    """Sum of the tie-breakers with unknown as zero, clamped unevenly."""
    total = reduce(lambda a, b: a + b, [F.coalesce(t.cast("double"), F.lit(0.0)) for t in terms], F.lit(0.0))
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def compose(criteria: list[tuple[Column, float]], preferences: Column, price_known: Column) -> dict[str, Column]:
    """score, confidence and ceiling of (points or null, weight) criteria.

    Points are scaled to 100 by the measurable weight if that is from 40 to below 100, rounded and clamped; then preferences
    come on top, clamped again. A listing without a price keeps 69 % of that, rounded again; the ceiling gives the full weight
    to everything that wasn't measured.
    """
    zero = F.lit(0.0)
    raw = reduce(lambda a, b: a + b, [F.coalesce(c, zero) for c, _ in criteria])
    measurable = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), float(w)).otherwise(0.0) for c, w in criteria])
    missing = reduce(lambda a, b: a + b, [F.when(c.isNull(), float(w)).otherwise(0.0) for c, w in criteria])
    clamp = lambda x: F.greatest(zero, F.least(F.lit(100.0), x))
    normal = F.when(measurable <= 0, zero).when((measurable >= 40) & (measurable < 100), clamp(F.bround(100 * raw / measurable))).otherwise(clamp(raw))
    score = clamp(normal + preferences)
    score = F.when(price_known, score).otherwise(F.bround(score * 69 / 100))
    return {"score": F.bround(score).cast("int"), "confidence": F.bround(measurable).cast("int"), "ceiling": F.bround(clamp(raw + missing + preferences)).cast("int")}


def band(score: Column) -> Column:
    """Label of the score's band."""
    return F.when(score >= 85, "excellent").when(score >= 70, "very good").when(score >= 55, "good").when(score >= 40, "fair").otherwise("low")


def strong_and_weak(names: list[str], shares: list[Column]) -> tuple[Column, Column]:
    """The two best criteria with .85 or more of their weight, and the two worst with .45 or less; unknown ones are neither."""
    all_ = F.array(*[F.struct(s.alias("s"), F.lit(n).alias("n")) for n, s in zip(names, shares, strict=True)])
    best = F.reverse(F.array_sort(F.filter(all_, lambda x: x["s"] >= 0.85)))
    worst = F.array_sort(F.filter(all_, lambda x: x["s"] <= 0.45))
    pick = lambda a: F.array_join(F.transform(F.slice(a, 1, 2), lambda x: x["n"]), ",")
    return pick(best), pick(worst)


def missing_fields(columns: list[str], most: int = 4) -> Column:
    """Names of the unknown columns in order, at most ``most``."""
    return F.array_join(F.slice(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])), 1, most), ",")


def market_difference(price: Column, median: Column, silent_pct: float = 4.0) -> Column:
    """Whole percent above or below the median; null within the silent band."""
    pct = F.bround(100 * F.try_divide(price - median, median))
    return F.when(F.abs(pct) > silent_pct, pct.cast("int"))


def monthly_cost(rent: Column, fees: Column) -> Column:
    return rent + F.coalesce(fees, F.lit(0.0))


def fee_pct(rent: Column, fees: Column) -> Column:
    return F.bround(100 * F.try_divide(fees, rent), 1)


def gate_implausible_price(rent: Column, area: Column, least_rate: float = 4000.0) -> tuple[Column, Column]:
    """(rent, doubtful rent): a rent per area below the least rate is moved aside."""
    bad = F.coalesce(F.try_divide(rent, area) < least_rate, F.lit(False))
    return F.when(~bad, rent), F.when(bad, rent)
