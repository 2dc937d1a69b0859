"""The ledger of building years: what listings say of their building is learnt first, then answers its other listings.

A ledger has a row for each building: (building, year, disputed, source, url, noted). Two years for one building leave it without
a year for good, as nobody can tell which is wrong; ``disputed`` keeps the first two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.streets import is_door

#: Years below the first, and beyond the next few, are errors of reading.
FIRST_YEAR, AHEAD = 1900, 3


def reachable(ledger: DataFrame) -> DataFrame:
    """Ledger rows under keys that addresses still get; others can't be asked for any more."""
    return ledger.where(is_door(F.col("building")))


def learn(ledger: DataFrame, listings: DataFrame, order: str, as_of: Column) -> DataFrame:
    """The ledger after the listings (building, built, source, url and ``order``), taken in their order.

    Rows of one building are counted by year before they move on, so a building has at most a row for each year of the band,
    however many listings it has. Listings without a building (null) or without a credible year teach nothing.
    """
    credible = F.col("built").between(FIRST_YEAR, F.year(as_of) + AHEAD)
    said = listings.where(F.col("building").isNotNull() & credible).groupBy("building", F.col("built").cast("int").alias("year")).agg(F.min(F.struct(order, "source", "url")).alias("first"))
    told = said.groupBy("building").agg(F.array_sort(F.collect_list(F.struct("first", "year"))).alias("told"))
    both = reachable(ledger).withColumn("known", F.lit(True)).join(told, "building", "full")
    first = F.get("told", F.lit(0))
    # what differs: from the ledger's year, or else from the first year told
    both = both.withColumn("_before", F.when(F.col("known"), F.col("year")).otherwise(first["year"]))
    both = both.withColumn("_other", F.get(F.filter("told", lambda t: t["year"] != F.col("_before")), F.lit(0))["year"])
    both = both.withColumn("_clash", F.col("_other").isNotNull())
    clash, new = F.col("_clash"), F.col("known").isNull()
    said_now = lambda c: F.when(clash, None).when(new, first["first"][c]).otherwise(F.col(c))
    return both.select(
        "building", F.when(~clash, F.col("_before")).alias("year"), F.when(clash, F.array("_before", "_other")).otherwise(F.col("disputed")).alias("disputed"),
        said_now("source").alias("source"), said_now("url").alias("url"), F.when(clash | new, as_of).otherwise(F.col("noted")).alias("noted"),
    )


def answer(listings: DataFrame, ledger: DataFrame, as_of: Column) -> DataFrame:
    """Listings with the ledger's year where they have none, the age that follows where that's unknown, and ``from_ledger``.

    Only listings that ask are joined, so null buildings don't meet in one task; the others pass by.
    """
    asks = F.coalesce(F.col("built").isNull() & F.col("building").isNotNull(), F.lit(False))
    years = ledger.where(F.col("year").isNotNull()).select("building", F.col("year").alias("_year"))
    asked = listings.where(asks).join(years, "building", "left")
    age = F.coalesce("age", F.when(F.col("_year").isNotNull(), F.greatest(F.lit(0), F.year(as_of) - F.col("_year"))))
    told = asked.withColumns({"built": F.col("_year").cast(listings.schema["built"].dataType), "age": age.cast(listings.schema["age"].dataType), "from_ledger": F.col("_year").isNotNull()})
    return listings.where(~asks).withColumn("from_ledger", F.lit(False)).unionByName(told.drop("_year"))
