"""Five ordered passes that collapse the copies of one home: identity, address, full text, nearness, broker code.

Listings have the columns of ``COLUMNS`` and any others that are to be filled. The order of the listings matters (the first
of a block is its first principal), so each pass hands on the place that the next one sorts by. Groups are collapsed by
aggregates that combine before the shuffle, and blocks of possible copies are streamed, so no group is ever held whole. Each pass
writes its rows and what it moved, and the next one reads them: a plan of one pass is small, and a lost executor costs a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key_text
from . import entities
from .board import listing_code
from .passing import Passing

#: ``ord``: unique place in the input; ``key``: address key ('' or null for none); ``direct``: the url leads to the listing.
COLUMNS = ("ord", "fp", "key", "place", "unit", "source", "title", "text", "address", "price", "area", "lat", "lon", "beds", "baths", "code", "score", "direct")
#: What a pass returns: its rows, and (ord, into) of the rows that it merged into others.
Pass = tuple[DataFrame, DataFrame]


def _collapsed(df: DataFrame, entity: Column, fill: list[str], run: Passing, before: tuple[Column, ...] = ()) -> Pass:
    """One row for each entity, written. ``before``: what ranks a row above its score.

    The best by score, direct link and number of known fields is kept, the first on a tie, and its unknown fields are taken
    from the others in order. Prices and other fields outside ``fill`` stay its own.
    """
    named = df.withColumn("_e", entity).withColumn("_rich", entities.richness(fill))
    rank = F.struct(*before, (-F.coalesce("score", F.lit(0))).alias("s"), (~F.coalesce("direct", F.lit(False))).alias("d"), (-F.col("_rich")).alias("r"), F.col("_at").alias("a"))
    others = [F.min_by(F.when(_known(df, c), F.col(c)), F.when(_known(df, c), F.col("_fill"))).alias(f"_f_{c}") for c in fill]
    best = named.groupBy("_e").agg(F.min_by(F.struct(*df.columns), rank).alias("_b"), F.min("_at").alias("_first"), F.sum("copies").alias("_n"), F.count("*").alias("_k"), *others)
    values = {c: F.col(f"_b.{c}") for c in df.columns} | {c: F.when(_known(df, c, "_b."), F.col(f"_b.{c}")).otherwise(F.col(f"_f_{c}")) for c in fill}
    out = run.held(best.select("_e", "_first", (F.col("_k") > 1).alias("_many"), *[v.alias(c) for c, v in (values | {"copies": F.col("_n")}).items()]))
    heads = out.where("_many").select("_e", F.col("ord").alias("into"))
    return out.drop("_many"), run.held(named.select("ord", "_e").join(heads, "_e").where("ord <> into").select("ord", "into"))


def _known(df: DataFrame, c: str, prefix: str = "") -> Column:
    value = F.col(f"{prefix}{c}")
    return (value.isNotNull() & (value != "")) if df.schema[c].dataType.typeName() == "string" else value.isNotNull()


def _row(df: DataFrame) -> Column:
    return F.concat(F.lit("row|"), F.col("ord").cast("string"))


def _placed(df: DataFrame, at: Column) -> DataFrame:
    """The rows with the place that the next pass sorts by; what is filled is taken in that order."""
    return df.withColumn("_at", at).drop("_e", "_first").withColumn("_fill", F.col("_at"))


def by_identity(df: DataFrame, fill: list[str], run: Passing) -> Pass:
    out, moved = _collapsed(df, F.coalesce("fp", _row(df)), fill, run)
    return _placed(out, F.col("_first")), moved


def second_sign(df: DataFrame) -> Column:
    """What has to agree beside the street. A key with a house number names a building and needs nothing; a street alone needs the
    exact price, in pesos or else in UF, or else the programme and area; where none is known nothing but the identity agrees."""
    price, uf = F.col("price"), F.col("price_uf") if "price_uf" in df.columns else F.lit(None).cast("double")
    known = lambda c: F.coalesce(c != 0, F.lit(False))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return (
        F.when(F.col("key").rlike(r"(?U)\b\d{3,}\b"), "")
        .when(known(price), F.concat(F.lit("clp:"), F.floor(price).cast("string")))
        .when(known(uf), F.concat(F.lit("uf:"), uf.cast("string")))
        .when(known(F.col("beds")) | known(F.col("area")), F.concat(F.lit("prog:"), text(F.col("beds")), F.lit("/"), text(F.col("area"))))
        .otherwise(F.concat(F.lit("solo:"), F.coalesce("fp", _row(df))))
    )


def by_address(df: DataFrame, fill: list[str], run: Passing) -> Pass:
    """Copies at one door, or on one street with a second sign; where a door holds several units each is a home, and a row without a
    unit joins the only unit of its exact price. Rows without a door come first and are left alone."""
    door = F.when((F.col("key") != "") & (F.col("place") != ""), F.concat_ws("|", "key", key_text(F.col("place")), second_sign(df)))
    unit = F.when(F.col("unit") != "", F.upper("unit"))
    named = run.held(df.withColumns({"_door": door, "_unit": unit, "_ord": F.col("ord")}))
    groups = entities.unit_groups(named.select("ord", "_at", "_door", "_unit", "_ord", "price"), "_door", "_unit", "price").withColumnRenamed("entity", "_group")
    firsts = named.groupBy("_door").agg(F.min("_at").alias("_door_at"))
    groups = groups.where("_door is not null").join(firsts, "_door").select("ord", "_door_at", F.startswith("_group", F.lit("row|")).alias("_loose"), "_group")
    named = named.join(groups, "ord", "left").withColumn("_group", F.coalesce("_group", _row(df)))
    out, moved = _collapsed(named.select(*df.columns, "_door", "_door_at", "_loose", "_group"), F.col("_group"), fill, run)
    at = F.struct(F.col("_door").isNotNull().alias("a"), F.col("_door_at").alias("b"), (~F.col("_loose")).alias("c"), F.col("_first").alias("d"))
    return _placed(out, at).drop("_door", "_door_at", "_loose", "_group"), moved


def by_text(df: DataFrame, fill: list[str], run: Passing, least: int = 80) -> Pass:
    """Copies of a whole text of one source among rows without an address; the others come first."""
    words = key_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    hash_ = F.when((F.coalesce("address", F.lit("")) == "") & (F.length(words) >= least), F.concat_ws("|", F.coalesce("source", F.lit("")), F.sha1(words)))
    out, moved = _collapsed(df.withColumn("_h", hash_), F.coalesce("_h", _row(df)), fill, run)
    return _placed(out, F.struct(F.col("_h").isNotNull().alias("a"), F.col("_first").alias("b"))).drop("_h"), moved


def _by_principal(df: DataFrame, blocks: dict[str, Column], near, fill: list[str], run: Passing) -> Pass:
    named = df.withColumns({**blocks, "_rich": entities.richness(fill)})
    many = named.where(" and ".join(f"{c} is not null" for c in blocks)).groupBy(*blocks).count().where("count > 1").select(*blocks)
    merges = run.held(entities.principal_merges(named.join(many, list(blocks)), list(blocks), "ord", ["_at"], ["score", "_rich"], near))
    last = merges.groupBy(*blocks).agg(F.max_by("merged_into", "nth").alias("_into"))
    # the last principal keeps its own and takes from the principals before it, the latest first, then from the others in order
    place = F.struct(F.when(F.col("was_head"), 1).otherwise(2).alias("a"), F.when(F.col("was_head"), -F.col("nth")).otherwise(F.col("nth")).alias("b"))
    lost = merges.join(last, list(blocks)).select(F.col("loser").alias("ord"), "_into", place.alias("_place"))
    first = F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"))
    heads = last.select(F.col("_into").alias("ord"), F.lit(None).cast(df.schema["ord"].dataType).alias("_into"), first.alias("_place")).distinct()
    touched = lost.unionByName(heads)
    held = df.join(touched, "ord").withColumn("_fill", F.col("_place")).select(*df.columns, "_into")
    out, moved = _collapsed(held, F.coalesce("_into", "ord"), fill, run, (F.col("_into").isNotNull().alias("l"),))
    rest = df.join(touched.select("ord"), "ord", "left_anti")
    columns = [c for c in df.columns if c not in ("_at", "_fill")]
    return _placed(out.select(*columns, F.col("_at").alias("_first")).unionByName(rest.select(*columns, F.col("_at").alias("_first"))), F.col("_first")), moved


def by_nearness(df: DataFrame, fill: list[str], run: Passing, km: float = 0.12) -> Pass:
    """Copies of one price and area, to whole numbers, on one spot, with bedrooms and baths that differ by one at most."""
    there = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("price") != 0) & (F.col("area") != 0)
    blocks = {"_b_price": F.when(there, F.bround("price").cast("long")), "_b_area": F.when(there, F.bround("area").cast("long"))}
    return _by_principal(df, blocks, entities.within("lat", "lon", km, {"beds": 1, "baths": 1}), fill, run)


def by_code(df: DataFrame, fill: list[str], run: Passing) -> Pass:
    """Copies of one broker code whose areas or prices agree, with bedrooms and baths that differ by one at most.

    Where the listings have no ``code``, it is read from the title and text.
    """
    code = F.col("code") if "code" in df.columns else listing_code(F.concat_ws(" ", "title", "text"))
    near = entities.same_offer("area", "price", {"beds": 1, "baths": 1})
    return _by_principal(df, {"_b_code": F.nullif(code, F.lit(""))}, near, fill, run)


PASSES = {"identity": by_identity, "address": by_address, "text": by_text, "nearness": by_nearness, "code": by_code}


def deduplicate(listings: DataFrame, fill: list[str]) -> tuple[DataFrame, DataFrame]:
    """(homes, membership): one row for each home with its number of ``copies``, and (ord, into, by) for every listing: the listing
    that stands for it, and the pass that merged it into another one (null if it stands for itself). ``also_in`` makes of that
    where else a home is published.

    Both are written tables in the session's shared folder; ``homes.passing.release()`` deletes them. Defined results: an unknown identity, door, text, spot or code matches
    nothing; an empty text to fill is unknown and comes back as null; an empty table gives empty results.
    """
    run = Passing(listings.sparkSession, "dedup")
    df = run.held(_placed(listings.withColumn("copies", F.lit(1).cast("long")), F.col("ord")))
    members = df.select("ord", F.col("ord").alias("into"), F.lit(None).cast("string").alias("by"))
    for name, one_pass in PASSES.items():
        df, moved = one_pass(df, fill, run)
        moved = moved.select(F.col("ord").alias("into"), F.col("into").alias("_next"))
        members = members.join(moved, "into", "left").select("ord", F.coalesce("_next", "into").alias("into"), F.coalesce("by", F.when(F.col("_next").isNotNull(), name)).alias("by"))
    homes, members = run.held(reduce(lambda d, c: d.drop(c), ("_at", "_fill"), df)), run.held(members)
    run.release(homes, members)
    homes.passing = members.passing = run
    return homes, members


def also_in(listings: DataFrame, members: DataFrame, source: str = "source", url: str = "url") -> DataFrame:
    """(into, tag): for each home the different ``source|url`` under which it's published beside its own, a row for each."""
    tags = listings.select("ord", F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(url, F.lit(""))).alias("tag"))
    own = tags.select(F.col("ord").alias("into"), F.col("tag").alias("_own"))
    return members.where("ord <> into").join(tags, "ord").select("into", "tag").distinct().join(own, "into").where("tag <> _own").select("into", "tag")
