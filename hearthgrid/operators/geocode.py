"""Coordinates of listings from a table of earlier answers, and the table's own upkeep: misses count too, and age.

The cache has a row for each normal form of a query: ``query``, ``lat``, ``lon`` (a hit), ``street`` (of a point; empty: asked, unknown;
null: never asked), ``failed`` (date of the last miss), ``attempts`` and ``seen`` (date of last use). Asking is somebody else's job:
``questions`` says what to ask and in which order, and ``refreshed`` takes the answers in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km

COLUMNS = ("query", "lat", "lon", "street", "failed", "attempts", "seen")
#: Days until a miss is asked again, and until an entry that nobody uses is forgotten; questions of one run; farthest plausible place.
RETRY_DAYS, FORGET_DAYS, MOST, MOST_KM = 30, 180, 25, 40.0


def cache_key(query: Column) -> Column:
    """Lower case, points, commas and white space as one space; two ways to write a query are one entry."""
    t = F.regexp_replace(F.replace(F.lower(F.trim(query)), F.lit("."), F.lit(" ")), r"[\s,]+", " ")
    return F.btrim(t, F.lit(" ,"))


def point_key(lat: Column, lon: Column) -> Column:
    """Entry of a point, to five decimals."""
    return cache_key(F.format_string("@%.5f,%.5f", lat, lon))


def _forms(listings: DataFrame, key: str, variants: Column, lat: str, address: str) -> DataFrame:
    """(key, place, query): the ways to ask for each listing that has an address and no coordinates, the most specific first."""
    needs = listings.where(F.col(lat).isNull() & (F.trim(F.col(address)) != ""))
    return needs.select(key, F.posexplode(variants).alias("place", "_form")).select(key, "place", cache_key(F.col("_form")).alias("query")).where("query <> ''")


def locate(listings: DataFrame, cache: DataFrame, variants: Column, centre: tuple[float, float] | None = None, key: str = "id", lat: str = "lat", lon: str = "lon", address: str = "address", most_km: float = MOST_KM) -> tuple[DataFrame, DataFrame]:
    """(listings with ``geo_origin``, (query) of the entries that were used). The first form with a known answer gives the place.

    A place more than ``most_km`` from the ``centre`` is another town's street of that name and isn't taken, though its entry was
    used. Rows of one ``key`` are one listing. Rows that know their coordinates, or have no address, stay.
    """
    hits = cache.where("lat is not null").select("query", F.struct("lat", "lon").alias("_at"))
    found = _forms(listings, key, variants, lat, address).join(hits, "query").groupBy(key).agg(F.min_by(F.struct("_at", "query"), "place").alias("_hit"))
    used = found.select("_hit.query").distinct()
    near = F.lit(True) if centre is None else haversine_km(F.col("_hit._at.lat"), F.col("_hit._at.lon"), *centre) <= most_km
    taken = found.where(near)
    out = listings.join(taken, key, "left").withColumn("_new", F.col(lat).isNull() & F.col("_hit").isNotNull())
    value = {lat: F.when(F.col("_new"), F.col("_hit._at.lat")).otherwise(F.col(lat)), lon: F.when(F.col("_new"), F.col("_hit._at.lon")).otherwise(F.col(lon))}
    return out.select(*[value.get(c, F.col(c)).alias(c) for c in listings.columns], F.when(F.col("_new"), "address").alias("geo_origin")), used


def due(as_of: Column) -> Column:
    """Whether an entry (joined, so all null where there's none) is worth a question: never answered, and no miss within RETRY_DAYS."""
    return F.col("lat").isNull() & (F.col("failed").isNull() | (F.date_diff(as_of, F.col("failed")) >= RETRY_DAYS))


def questions(listings: DataFrame, cache: DataFrame, variants: Column, order: str, as_of: Column, key: str = "id", lat: str = "lat", address: str = "address", most: int = MOST) -> DataFrame:
    """(nth, query): what to ask for the listings that no entry places, in the listings' order and theirs of forms, at most ``most``.

    The number of questions is the asked service's courtesy, not a cut of the data: what isn't asked now is the first next time.
    """
    forms = _forms(listings.select(key, order, lat, address, variants.alias("_variants")), key, F.col("_variants"), lat, address)
    known = forms.join(cache.select("query", "lat", "failed"), "query", "left")
    placed = known.where("lat is not null").select(key).distinct()
    open_ = known.join(placed, key, "left_anti").where(due(as_of)).join(listings.select(key, order), key)
    first = open_.groupBy("query").agg(F.min(F.struct(order, "place")).alias("_o")).orderBy("_o", "query").limit(most)
    return first.select(F.row_number().over(Window.orderBy("_o", "query")).alias("nth"), "query")


def streets(listings: DataFrame, cache: DataFrame, lat: str = "lat", lon: str = "lon", address: str = "address", place: str = "place") -> tuple[DataFrame, DataFrame]:
    """(listings with ``address_origin``, (query) used): an address for those that have coordinates only, from what is known of the
    point; "asked and unknown" gives none but counts as use."""
    named = listings.withColumn("_q", F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull() & (F.coalesce(F.trim(F.col(address)), F.lit("")) == ""), point_key(F.col(lat), F.col(lon))))
    side = cache.where("street is not null").select(F.col("query").alias("_q"), "street")
    used = named.select("_q").where("_q is not null").distinct().join(side, "_q").select(F.col("_q").alias("query"))
    out = named.join(side, "_q", "left").withColumn("_new", F.coalesce(F.col("street") != "", F.lit(False)))
    town = F.nullif(F.trim(F.col(place)), F.lit(""))
    value = F.when(F.col("_new"), F.concat_ws(", ", "street", town)).otherwise(F.col(address))
    return out.select(*[value.alias(c) if c == address else F.col(c) for c in listings.columns], F.when(F.col("_new"), "pin").alias("address_origin")), used


def refreshed(cache: DataFrame, used: DataFrame, answers: DataFrame, as_of: Column) -> DataFrame:
    """The cache after a run: answers taken in, entries that were used marked, those that nobody used for FORGET_DAYS dropped.

    ``answers``: (query, lat, lon, street), one for each question; null coordinates and a null or empty street are a miss, which keeps
    count. A found place replaces the entry, a street is added to it. An entry without a date of use stays.

    One shuffle on the query; queries are normalised, an empty one is dropped, of several answers to one the first by value counts.
    """
    a = answers.select(cache_key(F.col("query")).alias("query"), F.struct("lat", "lon", "street").alias("_a")).where("query <> ''").groupBy("query").agg(F.min("_a").alias("_a"))
    u = used.select("query").distinct().withColumn("_u", F.lit(True))
    j = cache.join(a, "query", "full").join(u, "query", "left")
    got, point = F.col("_a").isNotNull(), F.startswith("query", F.lit("@"))
    hit = F.col("_a.lat").isNotNull()
    street = F.coalesce("_a.street", F.lit(""))
    miss = got & F.when(point, street == "").otherwise(~hit)
    value = {
        "lat": F.when(got & ~point, F.col("_a.lat")).otherwise(F.col("lat")), "lon": F.when(got & ~point, F.col("_a.lon")).otherwise(F.col("lon")),
        "street": F.when(got & point, street).when(got, F.lit(None)).otherwise(F.col("street")),
        "failed": F.when(miss, as_of).when(got & ~point, F.lit(None)).otherwise(F.col("failed")),
        "attempts": F.when(miss, F.coalesce("attempts", F.lit(0)) + 1).when(got & ~point, F.lit(None)).otherwise(F.col("attempts")),
        "seen": F.when(got | F.coalesce("_u", F.lit(False)), as_of).otherwise(F.col("seen")),
    }
    out = j.select("query", *[v.cast(cache.schema[c].dataType).alias(c) for c, v in value.items()])
    return out.where(F.col("seen").isNull() | (F.date_diff(as_of, F.col("seen")) <= FORGET_DAYS)).select(*COLUMNS)
