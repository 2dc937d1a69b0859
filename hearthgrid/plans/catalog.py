"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from ..functions.geo import haversine_km
from ..operators import board, dedup, entities, market, profile, ranks, records, scoring, state
from ..sources import listings, tables
from . import homes, pages

#: Anchor of the map queries.
LAT0, LON0 = -33.381591, -70.562037


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- market statistics ---------------------------------------------------------------------------------------------------


def median_price_by_brand_min4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.medians(_read(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", 2, name="median_price")


def upper_median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.ranked_values(_read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"upper_median": F.floor(F.expr("n / 2"))}).drop("n")


def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.histogram(_read(spark, sf_dir, "orders"), "o_totalprice", 20_000)


def monthly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.monthly_counts(_read(spark, sf_dir, "orders"), "o_orderdate")


def market_summary_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    as_of = F.lit(o.select(F.max("day")).scalar())
    new, gone, moved = (F.col("o_orderstatus") == x for x in "OFP")
    area, price = F.col("o_custkey") % 90, market.positive("o_totalprice")
    before = price * (10 + F.col("o_orderkey") % 7 - 3) / 10
    counts = {"appeared": new, "departed": gone, "moved": moved, "reduced": moved & (price < before)}
    measures = {
        "median_price": F.when(new, price),
        "median_rate": F.when(new & (area > 0), price / area),
        "median_days": F.when(gone & (F.col("o_orderkey") % 60 != 0), F.col("o_orderkey") % 60),
        "median_reduction_pct": F.when(moved & (price < before), 100 * (before - price) / before),
    }
    return market.trailing_summary(o, "day", as_of, 90, counts, measures)


def typical_fee_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By flag, and by line number with areas known for the first line only, so the plain median answers for the others."""
    li = _read(spark, sf_dir, "lineitem")
    fee = F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(F.col("l_extendedprice") * 100)
    area = F.when(F.col("l_linenumber") == 1, F.col("l_quantity"))
    by_flag = li.groupBy(F.col("l_returnflag").alias("of")).agg(market.typical_fee(fee, F.col("l_quantity"), 130.0).alias("typical_fee"))
    return by_flag.unionByName(li.groupBy(F.col("l_linenumber").cast("string").alias("of")).agg(market.typical_fee(fee, area, 130.0).alias("typical_fee")))


def p90_then_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.greatest(F.lit(3.0), F.least(F.lit(8.0), F.col("p90") / 1000 * 2.2))
    found = ranks.ranked_values(_read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal", {"p90": F.floor(F.expr("0.9D * n"))})
    return found.drop("n").withColumn("side", F.bround(side, 4))


def coverage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    return market.coverage(c, ["c_name", "balance", "segment"])


def source_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return market.calibration(o, "o_orderpriority", F.col("o_orderstatus") == "O", F.col("o_totalprice") > 100_000, [F.desc("o_totalprice"), F.asc("o_orderkey")], "o_orderkey")


def rank_topk_carryover(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return market.top_k_with_carry_over(o, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select("o_orderkey", "o_orderpriority", "rank", "pending")


def retention_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.retain_last(_read(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 400).select("event_id", "user_id")


def enrichment_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    missing = F.when(F.col("c_acctbal") < 0, 1).otherwise(0) + F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)
    return c.select("c_custkey", missing.alias("missing"), "c_acctbal").orderBy(F.desc("missing"), F.desc("c_acctbal"), "c_custkey").limit(100)


def distinct_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").withColumn("slug", text.slug(F.col("p_brand"), F.col("p_type")))
    return market.first_per_key(p, "slug", [F.desc("p_retailprice"), F.asc("p_partkey")]).select("slug", "p_partkey")


def coincident_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 0.01).alias("lat"), (F.col("c_nationkey") * -0.02).alias("lon"))
    out = market.spread_coincident(c, "lat", "lon", "c_custkey")
    return out.select("c_custkey", "nth", (F.bround("lat_shown", 4) + 0.0).alias("lat_shown"), (F.bround("lon_shown", 4) + 0.0).alias("lon_shown"))


def viewport_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _located(spark, sf_dir)
    return market.viewport(c, "lat", "lon", F.col("km") < 4)


def kpi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    counts = o.agg(F.count("*").alias("live"), F.count_if(F.col("o_orderstatus") == "O").alias("new"), F.count_if(F.col("o_totalprice") < 50_000).alias("cheap"))
    middle = ranks.ranked_values(o, [], "o_totalprice", {"median_price": F.floor(F.expr("n / 2"))})
    return counts.withColumn("median_price", F.lit(middle.select("median_price").scalar()))


# --- eligibility and scores ----------------------------------------------------------------------------------------------


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with made-up coordinates around the anchor; every seventh has none."""
    k = F.col("c_custkey")
    lat = F.when(k % 7 != 0, LAT0 + (k % 101 - 50) / 1000)
    lon = F.when(k % 7 != 0, LON0 + (k % 89 - 44) / 1000)
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", lat.alias("lat"), lon.alias("lon"))
    return c.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), LAT0, LON0))


_LOCATED_SQL = f"""
located AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, lat, lon,
    2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians({LAT0}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({LAT0})) * pow(sin((radians({LON0}) - radians(lon)) / 2), 2)))) AS km
  FROM (SELECT *, CASE WHEN c_custkey % 7 <> 0 THEN {LAT0} + (c_custkey % 101 - 50) / 1000.0::DOUBLE END AS lat,
    CASE WHEN c_custkey % 7 <> 0 THEN {LON0} + (c_custkey % 89 - 44) / 1000.0::DOUBLE END AS lon FROM customer)
)"""


def haversine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).select("c_custkey", F.bround("km", 4).alias("km"))


def zone_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _located(spark, sf_dir).withColumn("place", F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")))
    inside = scoring.in_zone(F.col("place"), F.col("km"), ["BUILDING"], ["MACHINERY", "FURNITURE"], F.col("c_nationkey") % 2 == 0, 1.2, 4.0)
    return c.select("c_custkey", inside.alias("inside"))


def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rules = [("domain", F.col("p_brand") == "Brand#11"), ("type", F.col("p_size") > 40), ("area", F.col("l_quantity") < 10), ("price", F.col("l_extendedprice") > 50_000)]
    return li.groupBy(F.coalesce(scoring.first_violation(rules), F.lit("none")).alias("violation")).agg(F.count("*").alias("n"))


def null_never_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    why = scoring.first_violation([("status", status == "F"), ("price", price > 150_000)])
    return _read(spark, sf_dir, "orders").select("o_orderkey", why.alias("violation"))


def piecewise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size, price = _read(spark, sf_dir, "part"), F.col("p_size").cast("double"), F.col("p_retailprice")
    return p.select(
        "p_partkey",
        scoring.price_score(price, size, 1500.0).alias("price_score"),
        scoring.area_score(size * 5, 100.0, 130.0).alias("area_score"),
        scoring.age_score(size, 8.0, 15.0, 30.0).alias("age_score"),
        scoring.location_score(size / 10, F.lit(1.0), 0.9, 1.2).alias("location_score"),
        scoring.programme_score((F.col("p_size") % 6).cast("double"), (F.col("p_size") % 4).cast("double"), 3, 2).alias("programme_score"),
    )


def score_compose_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    criteria = [(F.when(k % 4 != 0, size / 2), 26.0), (F.when(k % 3 != 0, size / 3), 24.0), (F.when(k % 5 != 0, size / 4), 20.0), (size / 5, 30.0)]
    prefs = scoring.preference_score([F.when(k % 2 == 0, 8), F.when(k % 7 == 0, -9), F.when(k % 11 == 0, -6)])
    return _read(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in scoring.compose(criteria, prefs, k % 5 != 0).items()])


def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").groupBy(scoring.band(F.col("p_size") * 2).alias("band")).agg(F.count("*").alias("n"))


def strong_weak_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    best, worst = scoring.strong_and_weak(["area", "price", "age"], [s / 50, (50 - s) / 50, F.when(s % 5 != 0, (s % 10) / 10)])
    return _read(spark, sf_dir, "part").select("p_partkey", best.alias("strong"), worst.alias("weak"))


def missing_field_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    some = o.select("o_orderkey", *[F.when(F.col("o_orderkey") % n != 0, F.lit(1)).alias(c) for c, n in (("price", 2), ("area", 3), ("beds", 4), ("age", 5), ("fees", 6))])
    return some.select("o_orderkey", scoring.missing_fields(["price", "area", "beds", "age", "fees"]).alias("missing"))


def market_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    mid = p.groupBy("p_brand").agg(market.guarded_median(F.col("p_retailprice")).alias("mid"))
    return p.join(mid, "p_brand").select("p_partkey", scoring.market_difference(F.col("p_retailprice"), F.col("mid")).alias("pct"))


def cost_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rent, fees = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")), F.when(F.col("l_linenumber") != 2, F.floor(F.col("l_extendedprice") * F.col("l_tax")).cast("double"))
    kept, doubtful = scoring.gate_implausible_price(rent, F.col("l_quantity"), 1200.0)
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scoring.monthly_cost(rent, fees).alias("cost"), scoring.fee_pct(rent, fees).alias("fee_pct"), kept.alias("rent"), doubtful.alias("doubtful"))


# --- entities ------------------------------------------------------------------------------------------------------------


def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as listings: street and number from the key, place from the nation."""
    n = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = _read(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    number = F.col("c_custkey") % 40 * 25
    return c.select(
        "c_custkey", F.col("n_name").alias("place"), F.concat(F.lit("Av. Santa María N° "), number.cast("string"), F.lit(", "), F.col("n_name")).alias("address"),
        F.concat(F.lit("https://www.site.example.org/aviso/"), F.col("c_custkey").cast("string"), F.lit("/?ref=x")).alias("url"),
        F.concat(F.lit("Aviso N° 1."), (F.col("c_custkey") % 7).cast("string"), F.lit(": "), "c_mktsegment").alias("title"), (F.bround(F.col("c_acctbal"), -3) + 0.0).alias("price"), "c_mktsegment",
    )


_ADDRESSES_SQL = """
addresses AS (
  SELECT c_custkey, n_name AS place, CASE WHEN (c_custkey % 40) * 25 >= 100 THEN 'santa maria ' || (c_custkey % 40) * 25 ELSE '' END AS key,
    'https://www.site.example.org/aviso/' || c_custkey || '/?ref=x' AS url, 'aviso n 1' || c_custkey % 7 || ' ' || lower(c_mktsegment) AS detail, round_even(c_acctbal, -3) + 0.0 AS price, c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), identified AS (
  SELECT *, substr(sha1(CASE WHEN key <> '' THEN key || '|' || lower(place) ELSE url || '|' || detail END), 1, 16) AS fp FROM addresses
)"""


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _addresses(spark, sf_dir).withColumn("key", text.address_key(F.col("address"), F.col("place")))
    return a.withColumn("fp", text.fingerprint(F.col("key"), F.col("place"), F.lit(None).cast("string"), F.col("url"), F.col("title")))


def identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir).select("c_custkey", "key", "fp")


def human_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir).select("c_custkey", text.human_code(F.col("fp")).alias("code"))


def merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of one identity collapse to the dearest; its unknown segment is filled from the others."""
    a = _identified(spark, sf_dir).withColumn("segment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    out = entities.collapse(a, "fp", [F.desc("price"), F.asc("c_custkey")], ["segment"], F.col("c_custkey").cast("string"))
    return out.select("fp", "c_custkey", "price", "segment", "copies", "also_in")


def unit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _identified(spark, sf_dir).withColumn("unit", F.when(F.col("c_custkey") % 4 != 0, (F.col("c_custkey") % 2 + 801).cast("string")))
    a = a.withColumns({"_ord": F.col("c_custkey"), "group": F.when(F.col("key") != "", F.col("fp"))})
    return entities.unit_groups(a, "group", "unit", "price").groupBy("entity").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def exact_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.text_copies(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "text", "doc_id").select("doc_id", "source")


def blocked_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = _located(spark, sf_dir).withColumns({"price": F.bround(F.col("c_acctbal"), -3), "beds": (k % 5).cast("double"), "score": k % 7, "known": k % 3})
    return entities.merge_into_principal(c, ["price", "c_nationkey"], "c_custkey", ["c_custkey"], ["score", "known"], entities.within("lat", "lon", 1.5, {"beds": 1}))


def twin_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").withColumn("price", F.bround(F.col("c_acctbal"), -1))
    return entities.twins(c, ["c_nationkey", "c_mktsegment", "price"], "c_custkey").select("c_custkey", "twin_of", "n_twins")


def home_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as listings of a few hundred homes; some addresses are a street without a number, some have no code of their own."""
    k = F.col("c_custkey")
    known = lambda n, c: F.when(k % n != 0, c)
    c = _identified(spark, sf_dir).withColumns({"lat": known(7, LAT0 + k % 20 / 1000), "lon": known(7, F.lit(LON0))})
    key = F.when(F.col("key") == "", F.lit("")).when(k % 5 == 0, "santa maria").otherwise(F.col("key"))
    return c.select(
        k.cast("long").alias("ord"), F.when(F.col("key") != "", F.concat_ws("|", "fp", (k % 3).cast("string"))).alias("fp"), key.alias("key"), "place", known(4, (k % 2 + 801).cast("string")).alias("unit"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("source"), "url", "title",
        F.repeat(F.concat(F.lit("texto "), (k % 700).cast("string"), F.lit(" ")), 12).alias("text"), F.when(F.col("key") != "", F.col("address")).alias("address"), known(6, F.col("price") + 10_000).alias("price"), known(5, k % 9 * 10.0).alias("area"), "lat", "lon",
        known(7, (k % 4).cast("int")).alias("beds"), known(8, (k % 3).cast("int")).alias("baths"), F.when(k % 10 == 0, F.concat(F.lit("C"), (k % 400).cast("string"))).alias("code"), (k % 11).cast("int").alias("score"), (k % 2 == 0).alias("direct"),
    )


HOME_FIELDS = ["area", "beds", "baths", "address"]


def five_pass_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``into`` is the listing that stands for each, ``by`` the pass that merged it, ``elsewhere`` where else its home is published."""
    listings_ = home_listings(spark, sf_dir)
    homes, members = dedup.deduplicate(listings_, HOME_FIELDS)
    also = dedup.also_in(listings_, members).groupBy("into").agg(F.count("*").alias("elsewhere"))
    found = homes.select(F.col("ord").alias("into"), "copies", "area", "beds").join(also, "into", "left")
    return members.join(found, "into").withColumn("elsewhere", F.coalesce("elsewhere", F.lit(0)))


def broker_code_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").withColumns({"code": F.concat_ws("-", "p_brand", "p_type"), "beds": F.col("p_partkey") % 4})
    return entities.merge_into_principal(p, ["code"], "p_partkey", ["p_partkey"], ["p_retailprice"], entities.same_offer("p_size", "p_retailprice", {"beds": 1}))


# --- state ---------------------------------------------------------------------------------------------------------------


def unique_key_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("label"))
    known = _read(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("label"))
    return state.tiered_lookup(o, known, [["o_orderkey"], ["o_custkey", "day"], ["day"]], ["label"], "o_custkey").select("o_orderkey", "label", "tier")


def manual_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    manual = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, 0.0).alias("s_acctbal"), F.when(F.col("s_suppkey") % 9 == 0, "descartado").alias("state"))
    return state.override(s, manual, "s_suppkey", ["s_acctbal"], "state")


def conflict_annul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.annul_conflicts(_read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


def asof_latest_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities are made up of two values for each user, so runs of one identity occur."""
    e = _read(spark, sf_dir, "events").withColumn("fp", F.col("event_id") % 2)
    return state.latest_prior(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", "fp", "event_id").select("event_id", "prior")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").withColumn("level", F.floor(F.col("value") / 20).cast("double"))
    return state.change_points(e, "user_id", ["ts", "event_id"], "level")


def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("user_id", F.array_join(F.transform("points", lambda x: x.cast("long").cast("string")), ",").alias("points"))


def price_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level zero is an unknown price."""
    trend = state.price_trend(F.col("points"), F.col("days"), F.lit("2024-03-01").cast("date"))
    return _points(spark, sf_dir).select("user_id", trend["change_pct"].alias("change_pct"), trend["falls"].cast("long").alias("falls"), trend["span_days"].alias("span_days"))


def _snapshot(e: DataFrame, until: str) -> DataFrame:
    return e.where(F.col("ts") < F.lit(until).cast("timestamp")).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def snapshot_diff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return state.run_diff(_snapshot(e, "2024-01-20"), _snapshot(e, "2024-01-05"), "user_id", "value")


def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _identified(spark, sf_dir).select("c_custkey", "fp", "url")
    return state.novel(a, a.where("c_custkey % 2 = 0"), "fp", "url").select("c_custkey")


def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    old = _snapshot(e, "2024-01-05").select("user_id", "value", F.lit("2024-01-05").cast("date").alias("first_seen"), F.lit("2024-01-05").cast("date").alias("last_seen"), F.lit(1).alias("times_seen"), (F.col("user_id") % 4 == 0).alias("was_alerted"), F.lit(False).alias("pending"))
    seen = _snapshot(e, "2024-01-20").where("user_id % 3 <> 0").select("user_id", "value", (F.col("user_id") % 5 == 0).alias("alerted"), (F.col("user_id") % 7 == 0).alias("failed"))
    out = state.upsert(old, seen, "user_id", F.lit("2024-01-20").cast("date"), "value")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


def absence_three_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs are days and sources event types; a user is gone on the third live day of the source without an event."""
    e = _read(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    return state.departures(e, "event_type", "user_id", "day", 3).select("event_type", "user_id", F.col("gone_on").cast("string").alias("gone_on"))


def absence_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of the counter: the users known before a day, those seen on it, and the sources that delivered."""
    e = _read(spark, sf_dir, "events")
    day = F.lit("2024-01-15").cast("timestamp")
    known = e.where(F.col("ts") < day).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("source"), (F.first(F.col("user_id")) % 4).alias("missed"))
    run = e.where((F.col("ts") >= day) & (F.col("ts") < day + F.expr("interval 6 hours")) & (F.col("event_type") != "view"))
    return state.count_absences(known, run, run.select(F.col("event_type").alias("source")), "user_id", "source", "missed")


def ttl_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.to_date(F.max("ts")).alias("last_seen"))
    return state.purge(e, "last_seen", F.lit("2024-02-10").cast("date"), 12).select("user_id")


# --- text and pages ------------------------------------------------------------------------------------------------------


def host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = text.url_host(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", host.alias("host"), text.host_in(host, ["example.org", "spam-farm.example.com"]).alias("excluded"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("key"))


def link_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.page_links(_read(spark, sf_dir, "pages"), "page_id", "html", "^/[a-z]", 4)


def slug_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", text.title_of_url(F.col("url")).alias("title"))


def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    forms = F.array(F.concat(k, F.lit(".550.000")), F.concat(k, F.lit(",5")), k, F.concat(F.lit("1."), k), F.concat(k, F.lit(",550,000")), F.lit("abc"), F.concat(F.lit("1.2."), k), F.concat(F.lit("1.550,"), k), F.concat(F.lit("1 "), k, F.lit(" 000")), F.concat(F.lit(","), k), F.concat(k, F.lit(",550,000.25")), F.concat(k, F.lit(".34,5")), F.concat(k, F.lit(".5678")))
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(forms).alias("form", "raw"))
    return o.select("o_orderkey", "form", text.locale_number(F.col("raw")).alias("number"))


def ordered_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("secret", "(token|password) ?="), ("marked", "[#*$%]{3}"), ("table", " [|] "), ("loud", "!!"), ("spanish", "(^| )(que|los|las)( |$)"), ("german", "(^| )(und|der|die)( |$)")]
    d = _read(spark, sf_dir, "documents")
    return d.groupBy(F.coalesce(text.ordered_class(F.col("text"), rules), F.lit("other")).alias("label")).agg(F.count("*").alias("n"))


def longest_dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["the", "this", "that", "with", "and", "was", "of", "from", "are", "mente", "nicht", "pour"]
    return _read(spark, sf_dir, "documents").select("doc_id", text.longest_name(F.col("text"), names).alias("name"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


def tolerant_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    damaged = e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(4))).when(F.col("event_id") % 10 == 1, "").otherwise(F.col("props")).alias("line"))
    return tables.json_lines(damaged, "line", "k int")


def json_path_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.json_paths(_read(spark, sf_dir, "events"), F.concat(F.lit('{"type":"'), "event_type", F.lit('","seen":[{"user":'), F.col("user_id").cast("string"), F.lit('},{"other":1}],"props":'), "props", F.lit("}")))


def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of an older version with a key too many and a stale computed value, read, written and read again."""
    old = _read(spark, sf_dir, "orders").select(F.to_json(F.struct("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") * 1.0).alias("fees"), F.lit(-1.0).alias("cost"), F.lit("x").alias("gone"), F.struct(F.col("o_orderstatus").alias("status"), F.array("o_custkey").alias("ids")).alias("extras"))).alias("value"))
    schema = StructType.fromDDL("o_orderkey long, price double, fees double, cost double, extras variant")
    cost = {"cost": F.col("price") + F.coalesce("fees", F.lit(0.0))}
    once = records.from_lines(old, schema, cost)
    again = records.from_lines(records.to_lines(once, cost), schema, cost)
    return again.select("o_orderkey", "price", "fees", "cost", F.variant_get("extras", "$.status", "string").alias("status"), F.variant_get("extras", "$.ids[0]", "long").alias("first_id"))


def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, "region").withColumn("url", F.concat(F.lit("https://a.example/q"), F.when(F.col("r_regionkey") % 2 == 0, "?page=9&s=1").otherwise("")))
    return r.select("r_regionkey", F.posexplode(text.pages_of(F.col("url"), "page", 3)).alias("pos", "url"))


def first_empty_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey", F.month("o_orderdate").alias("page_no")).agg(F.count_if(F.col("o_totalprice") > 60_000).alias("n"))
    return tables.until_first_empty(o, ["o_custkey"], "page_no", "n")


def rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") * 10), F.abs("s_acctbal") * 7
    value, origin = text.rate_cascade([("env", a), ("cache", b)])
    return _read(spark, sf_dir, "supplier").select("s_suppkey", F.bround(value, 2).alias("value"), origin.alias("origin"))


def requirement_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings; every field is unknown for some."""
    k = F.col("p_partkey")
    known = lambda n, c: F.when(k % n != 0, c)
    host = F.when(k % 11 == 0, "m.portal.example").when(k % 13 == 0, "otherportal.example").otherwise("homes.example")
    req = board.Requirements(("portal.example",), types=("brushed", "plated"), area=60, area_tolerance=5, strict_area=True, bedrooms=2, bedroom_tolerance=0, count_service_room=True, age=40, price=1500)
    rules = board.requirement_rules(
        req, F.concat(F.lit("https://"), host, F.lit("/a")), known(3, F.when(k % 17 == 0, "venta").otherwise("arriendo")), known(4, F.split_part(F.split_part("p_type", F.lit(" "), F.lit(2)), F.lit(" "), F.lit(1))),
        known(5, F.col("p_size") * 5.0), known(7, k % 5), k % 2 == 0, known(6, k % 50), known(8, F.col("p_retailprice")),
    )
    why = scoring.first_violation(rules)
    return _read(spark, sf_dir, "part").select("p_partkey", why.alias("violation"), board.in_market(why).alias("in_market"))


def alert_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, score = F.col("p_partkey"), F.col("p_size")
    year = F.when(k % 3 != 0, True)
    asked = board.should_alert(F.when(k % 5 != 0, k % 7 == 0), score, F.when(k % 4 == 0, 100).otherwise(60), score + 15, year, without_year=False)
    return _read(spark, sf_dir, "part").select("p_partkey", asked.alias("alert"), board.should_alert(k % 7 == 0, score, F.lit(100), score + 15, year).alias("plain"))


def board_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    k, now = F.col("o_orderkey"), F.lit("1998-08-01 12:00:00").cast("timestamp")
    seen = F.when(k % 4 != 0, F.col("o_orderdate").cast("timestamp"))
    flags = board.board_flags(seen, k % 101 == 0, F.to_date("o_orderdate"), F.col("o_totalprice"), F.col("o_totalprice") * (1 + (k % 3 - 1) / 10), F.when(k % 8 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), now)
    before = F.round("o_totalprice") * (1 + (k % 5 - 2) / 10)
    said = board.returned_phrase(F.to_date("o_orderdate"), F.bround(before), F.round("o_totalprice"), F.lit("1992-06-01").cast("date"))
    return o.select("o_orderkey", *[c.alias(n) for n, c in flags.items()], board.pesos(F.when(k % 9 != 0, F.col("o_totalprice"))).alias("pesos"), board.plain_number((k % 40) * 25.25, " m2").alias("area"), said.alias("returned"))


def listing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    said = F.element_at(F.array(F.concat(F.lit("Gran vista. Cód. 108."), k.cast("string"), F.lit(" ok")), F.concat(F.lit("codigo: mpb-"), k.cast("string"), F.lit("-a2")), F.concat(F.lit("COD #"), k.cast("string")), F.lit("sin nada"), F.concat(F.lit("codos "), k.cast("string"))), (k % 5 + 1).cast("int"))
    return _read(spark, sf_dir, "customer").select("c_custkey", board.listing_code(said).alias("code"))


def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    source = F.concat_ws("-", "event_type", (F.col("user_id") % 9).cast("string")).alias("source")
    day = F.lit("2024-01-15").cast("timestamp")
    now = e.where((F.col("ts") >= day) & (F.col("ts") < day + F.expr("interval 2 hours"))).select(source)
    return board.run_statistics(now, e.select(source), e.where(F.col("ts") < day).select(source), "source")


def _listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of the three kinds that listings come in, and a fourth without any."""
    k = F.col("c_custkey")
    beds, baths, area = (k % 5 + 1).cast("string"), (k % 3 + 1).cast("string"), k % 90 + 40
    price = F.concat((k % 7 + 1).cast("string"), F.lit(".250.000"))
    item = F.to_json(F.struct(F.lit("Apartment").alias("@type"), F.concat(F.lit("/ficha/"), k.cast("string")).alias("@id"), F.lit("Piso").alias("name"), F.struct((k % 90 + 40).alias("value")).alias("floorSize"), (k % 5 + 1).alias("numberOfBedrooms"), F.struct((k % 7 * 1000 + 250_000).cast("string").alias("price"), F.lit("CLP").alias("priceCurrency")).alias("offers")))
    card = F.concat(F.lit("<article><a href='/ficha/"), k.cast("string"), F.lit("'>Piso alto</a> $ "), price, F.lit(" superficie total "), area.cast("string"), F.lit(" m², "), beds, F.lit(" dormitorios y "), baths, F.lit(" baños, con vista</article>"))
    state = F.concat(F.lit('{"props":{"list":[{"url":"/ficha/'), k.cast("string"), F.lit('","title":"Con vista","precio":'), (k % 7 * 1000 + 250_000).cast("string"), F.lit(',"dormitorios":'), beds, F.lit(',"superficieTotal":'), area.cast("string"), F.lit("}]}}"))
    html = F.when(k % 4 == 0, F.concat(F.lit('<script type="application/ld+json">'), item, F.lit("</script>"), card)).when(k % 4 == 1, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>"))).when(k % 4 == 2, F.concat(F.lit("<body><nav><a href='/x/1'>$ 1</a></nav>"), card, F.lit("</body>"))).otherwise("<p>nada</p>")
    return _read(spark, sf_dir, "customer").select(k.cast("long").alias("page_id"), F.lit("https://homes.example/lista").alias("url"), html.alias("html"))


def card_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of the driver's pages, which hold none, and of pages made of customers."""
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html").unionByName(_listing_pages(spark, sf_dir))
    return listings.assemble(listings.extract(pages)).select("page_id", "via", "url", "title", "price", "total", "bedrooms", "baths")


_PARSED = r"""CASE WHEN regexp_full_match(r, '[0-9]{1,3}(,[0-9]{3}){2,}(\.[0-9]+)?') THEN CAST(replace(r, ',', '') AS DOUBLE)
  WHEN regexp_full_match(r, '[0-9.]*,[0-9]+') THEN CAST('0' || replace(split_part(r, ',', 1), '.', '') || '.' || split_part(r, ',', 2) AS DOUBLE)
  WHEN regexp_full_match(r, '[0-9]+(\.[0-9]{3})*') THEN CAST(replace(r, '.', '') AS DOUBLE) WHEN regexp_full_match(r, '[0-9]+\.[0-9]+') THEN CAST(r AS DOUBLE) END"""
#: One principal for each block, walked row by row: {0} the numbered rows, {1} the test of p (principal) and n (next), {2} whether n ranks higher.
_WALK = """
w AS (
  SELECT block, i, key, CAST(NULL AS BIGINT) AS loser, CAST(NULL AS BIGINT) AS winner, key AS head FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.block, n.i, n.key, CASE WHEN {near} THEN CASE WHEN {higher} THEN p.key ELSE n.key END END, CASE WHEN {near} THEN CASE WHEN {higher} THEN n.key ELSE p.key END END,
    CASE WHEN {near} AND {higher} THEN n.key ELSE p.key END
  FROM w JOIN numbered n ON n.block = w.block AND n.i = w.i + 1 JOIN numbered p ON p.block = w.block AND p.key = w.head
)"""
_SNAPSHOT = "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts < TIMESTAMP '{0}' GROUP BY user_id"

ORACLES = {
    "median_price_by_brand_min4": "SELECT p_brand, count(p_retailprice) AS n, CASE WHEN count(p_retailprice) >= 4 THEN round_even(median(p_retailprice), 2) END AS median_price FROM part GROUP BY p_brand",
    "upper_median_price": "SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5 ORDER BY o_totalprice DESC) AS upper_median FROM orders GROUP BY o_orderpriority",
    "price_histogram": "SELECT floor(o_totalprice / 20000) * 20000 AS bin, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL AND (SELECT count(o_totalprice) FROM orders) >= 4 GROUP BY 1",
    "monthly_counts": "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1",
    "market_summary_window": """
WITH r AS (SELECT *, nullif(o_totalprice, 0) AS p, o_custkey % 90 AS a, o_orderkey % 60 AS d, nullif(o_totalprice, 0) * (10 + o_orderkey % 7 - 3) / 10 AS b FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) - 90 FROM orders)),
s AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN p END AS m1, CASE WHEN o_orderstatus = 'O' AND a > 0 THEN p / a END AS m2, CASE WHEN o_orderstatus = 'F' AND d <> 0 THEN d END AS m3, CASE WHEN o_orderstatus = 'P' AND p < b THEN 100 * (b - p) / b END AS m4 FROM r)
SELECT count(*) FILTER (o_orderstatus = 'O') AS appeared, count(*) FILTER (o_orderstatus = 'F') AS departed, count(*) FILTER (o_orderstatus = 'P') AS moved, count(m4) AS reduced,
  CASE WHEN count(m1) >= 4 THEN round_even(median(m1), 0) END AS median_price, CASE WHEN count(m2) >= 4 THEN round_even(median(m2), 0) END AS median_rate,
  CASE WHEN count(m3) >= 4 THEN round_even(median(m3), 0) END AS median_days, CASE WHEN count(m4) >= 4 THEN round_even(median(m4), 0) END AS median_reduction_pct FROM s""",
    "typical_fee_ratio": """
WITH l AS (SELECT *, CASE WHEN l_orderkey % 3 <> 0 THEN nullif(l_extendedprice * 100, 0) END AS fee FROM lineitem),
g AS (SELECT l_returnflag AS "of", fee, fee / l_quantity AS rate FROM l UNION ALL SELECT l_linenumber::VARCHAR, fee, CASE WHEN l_linenumber = 1 THEN fee / l_quantity END FROM l)
SELECT "of", CASE WHEN count(rate) >= 4 THEN round_even(median(rate) * 130.0::DOUBLE, -4) WHEN count(fee) >= 4 THEN round_even(median(fee), -4) END AS typical_fee FROM g GROUP BY 1""",
    "p90_then_clamp": """
WITH p AS (SELECT c_mktsegment, list_sort(list(c_acctbal))[CAST(floor(0.9 * count(*)) AS BIGINT) + 1] AS p90 FROM customer GROUP BY c_mktsegment)
SELECT c_mktsegment, p90, round_even(greatest(3.0::DOUBLE, least(8.0::DOUBLE, p90 / 1000 * 2.2::DOUBLE)), 4) AS side FROM p""",
    "coverage_profile": """
SELECT unnest(['c_name', 'balance', 'segment']) AS field, unnest([CAST(floor(100 * count(nullif(c_name, '')) / count(*)) AS BIGINT), CAST(floor(100 * count(*) FILTER (c_acctbal > 0) / count(*)) AS BIGINT),
  CAST(floor(100 * count(*) FILTER (c_custkey % 3 <> 0) / count(*)) AS BIGINT)]) AS pct FROM customer""",
    "source_calibration": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_core, count(*) FILTER (o_totalprice > 100000) AS n_pass,
  string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS best FROM r GROUP BY o_orderpriority""",
    "rank_topk_carryover": "SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER w AS INTEGER) AS rank, row_number() OVER w > 5 AS pending FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)",
    "retention_last_rows": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 400",
    "enrichment_priority": "SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) + CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS missing, c_acctbal FROM customer ORDER BY missing DESC, c_acctbal DESC, c_custkey LIMIT 100",
    "distinct_slug": """
WITH s AS (SELECT *, left(trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 90) AS slug FROM part)
SELECT slug, p_partkey FROM s QUALIFY row_number() OVER (PARTITION BY slug ORDER BY p_retailprice DESC, p_partkey) = 1""",
    "coincident_points": """
WITH c AS (SELECT c_custkey, c_nationkey * 0.01::DOUBLE AS lat, c_nationkey * -0.02::DOUBLE AS lon, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS nth FROM customer)
SELECT c_custkey, nth, round_even(lat + CASE WHEN nth > 0 THEN 1.4e-4::DOUBLE * sin(2.4::DOUBLE * nth) ELSE 0 END, 4) + 0.0 AS lat_shown, round_even(lon + CASE WHEN nth > 0 THEN 1.4e-4::DOUBLE * cos(2.4::DOUBLE * nth) ELSE 0 END, 4) + 0.0 AS lon_shown FROM c""",
    "viewport_box": f"WITH {_LOCATED_SQL} SELECT min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM located WHERE km < 4",
    "kpi_counts": "SELECT count(*) AS live, count(*) FILTER (o_orderstatus = 'O') AS new, count(*) FILTER (o_totalprice < 50000) AS cheap, quantile_disc(o_totalprice, 0.5 ORDER BY o_totalprice DESC) AS median_price FROM orders",
    "haversine_distance": f"WITH {_LOCATED_SQL} SELECT c_custkey, round_even(km, 4) AS km FROM located",
    "zone_predicate": f"""
WITH {_LOCATED_SQL}, z AS (SELECT *, CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS place FROM located)
SELECT c_custkey, CASE WHEN place IS NOT NULL AND c_nationkey % 2 = 0 AND coalesce(km > 4, false) THEN false WHEN place = 'BUILDING' THEN true WHEN place IS NULL THEN NOT coalesce(km > 4, false)
  WHEN place IN ('MACHINERY', 'FURNITURE') THEN km IS NULL OR km <= 1.2 ELSE false END AS inside FROM z""",
    "first_violation": """
SELECT CASE WHEN p_brand = 'Brand#11' THEN 'domain' WHEN p_size > 40 THEN 'type' WHEN l_quantity < 10 THEN 'area' WHEN l_extendedprice > 50000 THEN 'price' ELSE 'none' END AS violation, count(*) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "null_never_rejects": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderstatus = 'F' THEN 'status' WHEN o_orderkey % 5 <> 0 AND o_totalprice > 150000 THEN 'price' END AS violation FROM orders",
    "piecewise_scores": """
WITH q AS (SELECT p_partkey, p_size::DOUBLE AS s, p_retailprice / 1500.0::DOUBLE AS p, p_size * 5.0::DOUBLE AS a, p_size / 10.0::DOUBLE AS km, (p_size % 6)::DOUBLE AS bed, (p_size % 4)::DOUBLE AS bath FROM part),
x AS (SELECT *, round_even(20.0::DOUBLE * CASE WHEN p <= 0.55 THEN 1.0 WHEN p <= 1 THEN 1 - 0.25::DOUBLE * (p - 0.55::DOUBLE) / 0.45::DOUBLE ELSE greatest(0.0::DOUBLE, 0.55::DOUBLE - 0.45::DOUBLE * (p - 1) / 0.12::DOUBLE) END, 0) AS got FROM q)
SELECT p_partkey, CASE WHEN s > 20 THEN round_even(got * 0.8::DOUBLE, 0) ELSE got END AS price_score,
  round_even(16.0::DOUBLE * CASE WHEN a < 100 THEN 0.3::DOUBLE WHEN a < 130 THEN 0.55::DOUBLE + 0.3::DOUBLE * (a - 100) / 30 WHEN a < 170 THEN 0.85::DOUBLE + 0.15::DOUBLE * (a - 130) / 40 ELSE 1 END, 0) AS area_score,
  round_even(24.0::DOUBLE * CASE WHEN s <= 8 THEN 1.0::DOUBLE - 0.15::DOUBLE * s / 8 WHEN s <= 15 THEN 0.85::DOUBLE - 0.2::DOUBLE * (s - 8) / 7 WHEN s <= 30 THEN 0.65::DOUBLE - 0.4::DOUBLE * (s - 15) / 15 ELSE greatest(0.1::DOUBLE, 0.25::DOUBLE - 0.01::DOUBLE * (s - 30)) END, 0) AS age_score,
  round_even(26.0::DOUBLE * CASE WHEN km <= 0.9 THEN 1.0::DOUBLE WHEN km <= 1.2 THEN 1 - 0.35::DOUBLE * (km - 0.9::DOUBLE) / (1.2::DOUBLE - 0.9::DOUBLE) ELSE greatest(0.45::DOUBLE, 1 - 0.12::DOUBLE * (km - 1.2::DOUBLE)) END, 0) AS location_score,
  round_even(14.0::DOUBLE * 0.6::DOUBLE * (0.75::DOUBLE + 0.25::DOUBLE * least(greatest(bed - 3, 0), 2) / 2) + 14.0::DOUBLE * 0.4::DOUBLE * least(bath / 2, 1), 0) AS programme_score FROM x""",
    "score_compose_clamp": """
WITH q AS (SELECT p_partkey AS k, p_size::DOUBLE AS s FROM part), c AS (
  SELECT k, CASE WHEN k % 4 <> 0 THEN s / 2 END AS a, CASE WHEN k % 3 <> 0 THEN s / 3 END AS b, CASE WHEN k % 5 <> 0 THEN s / 4 END AS c, s / 5 AS d,
    greatest(-12.0, least(6.0, CASE WHEN k % 2 = 0 THEN 8.0 ELSE 0 END + CASE WHEN k % 7 = 0 THEN -9.0 ELSE 0 END + CASE WHEN k % 11 = 0 THEN -6.0 ELSE 0 END))::DOUBLE AS p FROM q
), t AS (SELECT k, p, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) + coalesce(d, 0) AS raw,
  (CASE WHEN a IS NULL THEN 0 ELSE 26 END + CASE WHEN b IS NULL THEN 0 ELSE 24 END + CASE WHEN c IS NULL THEN 0 ELSE 20 END + 30)::DOUBLE AS m FROM c),
u AS (SELECT k, m, greatest(0, least(100, greatest(0, least(100, CASE WHEN m >= 40 AND m < 100 THEN round_even(100 * raw / m, 0) ELSE raw END)) + p)) AS s, greatest(0, least(100, raw + 100 - m + p)) AS ceiling FROM t)
SELECT k AS p_partkey, CAST(round_even(CASE WHEN k % 5 <> 0 THEN s ELSE round_even(s * 69 / 100, 0) END, 0) AS INTEGER) AS score, CAST(m AS INTEGER) AS confidence, CAST(round_even(ceiling, 0) AS INTEGER) AS ceiling FROM u""",
    "band_counts": "SELECT CASE WHEN p_size * 2 >= 85 THEN 'excellent' WHEN p_size * 2 >= 70 THEN 'very good' WHEN p_size * 2 >= 55 THEN 'good' WHEN p_size * 2 >= 40 THEN 'fair' ELSE 'low' END AS band, count(*) AS n FROM part GROUP BY 1",
    "strong_weak_criteria": """
WITH q AS (SELECT p_partkey, [struct_pack(s := p_size / 50.0::DOUBLE, n := 'area'), struct_pack(s := (50 - p_size) / 50.0::DOUBLE, n := 'price'), struct_pack(s := CASE WHEN p_size % 5 <> 0 THEN (p_size % 10) / 10.0::DOUBLE END, n := 'age')] AS a FROM part)
SELECT p_partkey, coalesce(array_to_string(list_transform(list_reverse_sort(list_filter(a, lambda x: x.s >= 0.85))[1:2], lambda x: x.n), ','), '') AS strong,
  coalesce(array_to_string(list_transform(list_sort(list_filter(a, lambda x: x.s <= 0.45))[1:2], lambda x: x.n), ','), '') AS weak FROM q""",
    "missing_field_list": """
SELECT o_orderkey, coalesce(array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'price' END, CASE WHEN o_orderkey % 3 = 0 THEN 'area' END, CASE WHEN o_orderkey % 4 = 0 THEN 'beds' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'age' END, CASE WHEN o_orderkey % 6 = 0 THEN 'fees' END], lambda x: x IS NOT NULL)[1:4], ','), '') AS missing FROM orders""",
    "market_comparison": """
WITH m AS (SELECT p_brand, CASE WHEN count(*) >= 4 THEN round_even(median(p_retailprice), 0) END AS mid FROM part GROUP BY p_brand),
d AS (SELECT p_partkey, round_even(100 * (p_retailprice - mid) / mid, 0) AS pct FROM part JOIN m USING (p_brand))
SELECT p_partkey, CASE WHEN abs(pct) > 4 THEN CAST(pct AS INTEGER) END AS pct FROM d""",
    "cost_columns": """
WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS rent, CASE WHEN l_linenumber <> 2 THEN floor(l_extendedprice * l_tax) END AS fees FROM lineitem)
SELECT l_orderkey, l_linenumber, rent + coalesce(fees, 0) AS cost, round_even(100 * fees / rent, 1) AS fee_pct, CASE WHEN NOT coalesce(rent / l_quantity < 1200, false) THEN rent END AS rent,
  CASE WHEN rent / l_quantity < 1200 THEN rent END AS doubtful FROM q""",
    "identity_hash": f"WITH {_ADDRESSES_SQL} SELECT c_custkey, key, fp FROM identified",
    "human_code": f"""
WITH {_ADDRESSES_SQL}, n AS (SELECT c_custkey, ('0x' || substr(fp, 1, 12))::BIGINT AS n FROM identified)
SELECT c_custkey, array_to_string(list_transform([1, 31, 961, 29791, 923521], lambda d: '{text.CODE_ALPHABET}'[CAST(n // d % 31 + 1 AS BIGINT)]), '') AS code FROM n""",
    "merge_coalesce": f"""
WITH {_ADDRESSES_SQL}, s AS (SELECT *, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM identified),
g AS (SELECT fp, list(c_custkey ORDER BY price DESC, c_custkey) AS ids, list(price ORDER BY price DESC, c_custkey) AS prices, list(segment ORDER BY price DESC, c_custkey) FILTER (segment IS NOT NULL) AS segments, count(*) AS copies FROM s GROUP BY fp)
SELECT fp, ids[1] AS c_custkey, prices[1] AS price, segments[1] AS segment, copies, coalesce(array_to_string(list_sort(list_transform(ids[2:], lambda x: x::VARCHAR)), ','), '') AS also_in FROM g""",
    "unit_split": f"""
WITH {_ADDRESSES_SQL}, a AS (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 2 + 801 AS VARCHAR) END AS unit, CASE WHEN key <> '' THEN fp END AS g FROM identified),
n AS (SELECT g, count(DISTINCT unit) AS n FROM a WHERE unit IS NOT NULL AND g IS NOT NULL GROUP BY g),
b AS (SELECT g, price, min(unit) AS u FROM a WHERE unit IS NOT NULL AND g IS NOT NULL GROUP BY g, price HAVING count(DISTINCT unit) = 1),
e AS (SELECT c_custkey, CASE WHEN a.g IS NULL THEN 'row|' || c_custkey WHEN coalesce(n, 0) <= 1 THEN a.g WHEN coalesce(unit, u) IS NOT NULL THEN a.g || '|' || coalesce(unit, u) ELSE 'row|' || c_custkey END AS entity
  FROM a LEFT JOIN n ON a.g = n.g LEFT JOIN b ON a.g = b.g AND a.price = b.price)
SELECT entity, count(*) AS n, min(c_custkey) AS first FROM e GROUP BY entity""",
    "exact_text_dedup": f"""
WITH d AS (SELECT doc_id, source, trim(regexp_replace(lower(translate(coalesce(text, ''), '{text.ACCENTED}', '{text.PLAIN}')), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, source FROM d QUALIFY length(t) < 80 OR row_number() OVER (PARTITION BY source, t ORDER BY doc_id) = 1""",
    "blocked_near_dup": f"""
WITH RECURSIVE {_LOCATED_SQL}, numbered AS (
  SELECT c_custkey AS key, lat, lon, c_custkey % 5 AS beds, c_custkey % 7 AS score, c_custkey % 3 AS known, (round_even(c_acctbal, -3) + 0.0) || '|' || c_nationkey AS block,
    row_number() OVER (PARTITION BY round_even(c_acctbal, -3) + 0.0, c_nationkey ORDER BY c_custkey) AS i FROM located
), {_WALK.format(near="coalesce(abs(p.beds - n.beds) <= 1 AND 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(n.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(n.lat)) * pow(sin((radians(n.lon) - radians(p.lon)) / 2), 2)))) <= 1.5, false)", higher="(n.score, n.known) > (p.score, p.known)")}
SELECT c_custkey, winner AS merged_into FROM customer LEFT JOIN (SELECT loser, winner FROM w WHERE loser IS NOT NULL) ON c_custkey = loser""",
    "twin_listings": """
WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, round_even(c_acctbal, -1) AS price FROM customer), g AS (SELECT *, min(c_custkey) OVER w AS twin_of, count(*) OVER w - 1 AS n_twins FROM c WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment, price))
SELECT c_custkey, twin_of, n_twins FROM g WHERE n_twins > 0""",
    "broker_code_pairs": f"""
WITH RECURSIVE numbered AS (
  SELECT p_partkey AS key, p_size AS area, p_retailprice AS price, p_partkey % 4 AS beds, p_brand || '-' || p_type AS block, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS i FROM part
), {_WALK.format(near="((abs(p.area - n.area) <= 1 OR abs(p.price - n.price) <= 0.01::DOUBLE * greatest(p.price, n.price)) AND abs(p.beds - n.beds) <= 1)", higher="n.price > p.price")}
SELECT p_partkey, winner AS merged_into FROM part LEFT JOIN (SELECT loser, winner FROM w WHERE loser IS NOT NULL) ON p_partkey = loser""",
    "unique_key_fallback_join": """
WITH s AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS label FROM orders WHERE o_orderkey % 3 <> 0),
s2 AS (SELECT o_custkey, day, min(label) AS label FROM s GROUP BY ALL HAVING count(*) = 1), s3 AS (SELECT day, min(label) AS label FROM s GROUP BY day HAVING count(*) = 1)
SELECT o.o_orderkey, coalesce(CASE WHEN o.o_orderkey % 2 = 0 THEN o.o_orderpriority END, CASE WHEN s.day IS NOT NULL THEN s.label WHEN s2.day IS NOT NULL THEN s2.label ELSE s3.label END) AS label,
  CASE WHEN s.day IS NOT NULL THEN 1 WHEN s2.day IS NOT NULL THEN 2 WHEN s3.day IS NOT NULL THEN 3 END AS tier
FROM orders o LEFT JOIN s ON o.o_orderkey = s.o_orderkey LEFT JOIN s2 ON o.o_custkey = s2.o_custkey AND CAST(o.o_orderdate AS DATE) = s2.day LEFT JOIN s3 ON CAST(o.o_orderdate AS DATE) = s3.day""",
    "manual_override": "SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal, s_suppkey % 9 = 0 AS discarded FROM supplier",
    "conflict_annul": "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS value, count(DISTINCT l_returnflag) > 1 AS disputed FROM lineitem GROUP BY l_orderkey",
    "asof_latest_prior": """
SELECT e.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS prior FROM events e LEFT JOIN events c ON c.user_id = e.user_id AND c.event_type = 'click' AND c.event_id % 2 <> e.event_id % 2 AND (c.ts, c.event_id) < (e.ts, e.event_id) GROUP BY e.event_id""",
    "change_points": """
WITH l AS (SELECT user_id, ts, event_id, floor(value / 20) AS v, lag(floor(value / 20)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
m AS (SELECT * FROM l WHERE p IS NULL OR p <> v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12)
SELECT user_id, string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY ts, event_id) AS points FROM m GROUP BY user_id""",
    "price_trend": """
WITH l AS (SELECT user_id, ts, event_id, floor(value / 20) AS v, lag(floor(value / 20)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
m AS (SELECT * FROM l WHERE p IS NULL OR p <> v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12),
q AS (SELECT user_id, coalesce(list(v ORDER BY ts, event_id) FILTER (v <> 0), []) AS a, min(CAST(ts AS DATE)) FILTER (v <> 0) AS d FROM m GROUP BY user_id)
SELECT user_id, CASE WHEN len(a) >= 2 AND a[-1] <> a[1] THEN CAST(round_even(100 * (a[-1] - a[1]) / a[1], 0) AS INTEGER) END AS change_pct,
  CASE WHEN len(a) >= 2 AND a[-1] <> a[1] THEN CAST(len(list_filter(range(2, len(a) + 1), lambda i: a[i] < a[i - 1])) AS BIGINT) END AS falls,
  CASE WHEN len(a) >= 2 AND a[-1] <> a[1] THEN CAST(DATE '2024-03-01' - d AS INTEGER) END AS span_days FROM q""",
    "snapshot_diff_events": f"""
WITH new AS ({_SNAPSHOT.format('2024-01-20')}), old AS ({_SNAPSHOT.format('2024-01-05')})
SELECT user_id, CASE WHEN old.user_id IS NULL THEN 'alta' ELSE 'precio' END AS event, new.value, old.value AS before FROM new LEFT JOIN old USING (user_id) WHERE old.user_id IS NULL OR new.value <> old.value""",
    "novelty": f"""
WITH {_ADDRESSES_SQL} SELECT c_custkey FROM identified WHERE fp NOT IN (SELECT fp FROM identified WHERE c_custkey % 2 = 0) AND url NOT IN (SELECT url FROM identified WHERE c_custkey % 2 = 0)""",
    "state_upsert": f"""
WITH old AS ({_SNAPSHOT.format('2024-01-05')}), seen AS (SELECT * FROM ({_SNAPSHOT.format('2024-01-20')}) WHERE user_id % 3 <> 0),
j AS (SELECT coalesce(o.user_id, s.user_id) AS user_id, o.user_id IS NOT NULL AS had, s.user_id IS NOT NULL AS now, o.value AS ov, s.value AS sv FROM old o FULL JOIN seen s ON o.user_id = s.user_id),
w AS (SELECT *, (had AND user_id % 4 = 0) OR (now AND user_id % 5 = 0) AS was FROM j)
SELECT user_id, coalesce(sv, ov) AS value, CASE WHEN had THEN '2024-01-05' ELSE '2024-01-20' END AS first_seen, CASE WHEN now THEN '2024-01-20' ELSE '2024-01-05' END AS last_seen,
  CAST(had AS INTEGER) + CAST(now AS INTEGER) AS times_seen, was AS was_alerted, NOT was AND now AND user_id % 7 = 0 AS pending FROM w""",
    "absence_three_runs": """
WITH e AS (SELECT DISTINCT event_type, user_id, CAST(ts AS DATE) AS day FROM events), f AS (SELECT event_type, user_id, min(day) AS since FROM e GROUP BY ALL),
m AS (SELECT f.event_type, f.user_id, l.day, e.day IS NOT NULL AS seen FROM f JOIN (SELECT DISTINCT event_type, day FROM e) l ON f.event_type = l.event_type AND l.day >= since
  LEFT JOIN e ON e.event_type = f.event_type AND e.user_id = f.user_id AND e.day = l.day),
s AS (SELECT *, sum(CAST(seen AS INTEGER)) OVER (PARTITION BY event_type, user_id ORDER BY day) AS spell FROM m),
c AS (SELECT *, count(*) FILTER (NOT seen) OVER (PARTITION BY event_type, user_id, spell ORDER BY day) AS missed FROM s)
SELECT event_type, user_id, CAST(day AS VARCHAR) AS gone_on FROM c WHERE missed = 3 AND NOT seen""",
    "absence_counter": """
WITH k AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS source, user_id % 4 AS missed FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id),
r AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-15 06:00:00' AND event_type <> 'view'),
c AS (SELECT user_id, source, missed, CASE WHEN user_id IN (SELECT user_id FROM r) THEN 0 WHEN source IN (SELECT event_type FROM r) THEN missed + 1 ELSE missed END AS later FROM k)
SELECT user_id, source, later AS missed, later = 3 AND missed <> 3 AS gone FROM c""",
    "ttl_purge": "SELECT user_id FROM events GROUP BY user_id HAVING CAST(max(ts) AS DATE) >= DATE '2024-02-10' - 12",
    "host_suffix": """
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, host, host IN ('example.org', 'spam-farm.example.com') OR ends_with(host, '.example.org') OR ends_with(host, '.spam-farm.example.com') AS excluded FROM h""",
    "url_canonical": "SELECT page_id, regexp_replace(regexp_replace(split_part(split_part(lower(trim(url)), '#', 1), '?', 1), '^[a-z]+://(www\\.)?', ''), '/+$', '') AS key FROM pages",
    "link_lateral": """
WITH l AS (SELECT page_id, i, l[i] AS link FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages), unnest(range(1, len(l) + 1)) AS t(i)),
d AS (SELECT page_id, link, min(i) AS i FROM l WHERE regexp_matches(link, '^/[a-z]') GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, link FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 4""",
    "slug_title": """
WITH w AS (SELECT page_id, trim(regexp_replace(regexp_extract(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '\\.[A-Za-z]+$', ''), '([^/]*)/*$', 1), '[^A-Za-z0-9]+', ' ', 'g')) AS w FROM pages)
SELECT page_id, upper(left(w, 1)) || substr(w, 2) AS title FROM w""",
    "number_parse": f"""
WITH f AS (SELECT o_orderkey, unnest(range(0, 13)) AS form, unnest([k || '.550.000', k || ',5', k, '1.' || k, k || ',550,000', 'abc', '1.2.' || k, '1.550,' || k, '1' || k || '000', ',' || k, k || ',550,000.25', k || '.34,5', k || '.5678']) AS r FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS k FROM orders))
SELECT o_orderkey, CAST(form AS INTEGER) AS form, {_PARSED} AS number FROM f""",
    "ordered_classifier": """
SELECT CASE WHEN regexp_matches(text, '(token|password) ?=') THEN 'secret' WHEN regexp_matches(text, '[#*$%]{3}') THEN 'marked' WHEN regexp_matches(text, ' [|] ') THEN 'table' WHEN regexp_matches(text, '!!') THEN 'loud'
  WHEN regexp_matches(text, '(^| )(que|los|las)( |$)') THEN 'spanish' WHEN regexp_matches(text, '(^| )(und|der|die)( |$)') THEN 'german' ELSE 'other' END AS label, count(*) AS n FROM documents GROUP BY 1""",
    "longest_dictionary_match": "SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(text, '(^|[^A-Za-z0-9]){n}([^A-Za-z0-9]|$)') THEN '{n}'" for n in sorted(["the", "this", "that", "with", "and", "was", "of", "from", "are", "mente", "nicht", "pour"], key=lambda n: (-len(n), n)))
    + " END AS name FROM documents",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS total, count(json_extract(props, '$.k')) AS n FROM events GROUP BY event_type",
    "tolerant_json_lines": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 10 NOT IN (0, 1)",
    "json_path_profile": """
WITH p AS (SELECT 'type' AS path, 'string' AS kind, event_type AS v FROM events UNION ALL SELECT 'seen[].user', 'number', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT 'props.k', 'number', json_extract_string(props, '$.k') FROM events)
SELECT path, kind, CAST(count(*) AS BIGINT) AS n, min(v) AS example FROM p GROUP BY ALL""",
    "record_round_trip": """
SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey * 1.0 END AS fees, o_totalprice + CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey * 1.0 ELSE 0 END AS cost, o_orderstatus AS status, o_custkey AS first_id FROM orders""",
    "pagination": """
WITH u AS (SELECT r_regionkey, 'https://a.example/q' || CASE WHEN r_regionkey % 2 = 0 THEN '?page=9&s=1' ELSE '' END AS url FROM region)
SELECT r_regionkey, CAST(n - 1 AS INTEGER) AS pos, CASE WHEN n = 1 THEN url WHEN r_regionkey % 2 = 0 THEN replace(url, 'page=9', 'page=' || n) ELSE url || '?page=' || n END AS url FROM u, range(1, 4) AS t(n)""",
    "first_empty_page": """
WITH p AS (SELECT o_custkey, CAST(month(o_orderdate) AS INTEGER) AS page_no, count(*) FILTER (o_totalprice > 60000) AS n FROM orders GROUP BY ALL),
s AS (SELECT o_custkey, min(page_no) FILTER (n = 0) AS stop FROM p GROUP BY o_custkey)
SELECT o_custkey, page_no, n FROM p JOIN s USING (o_custkey) WHERE stop IS NULL OR page_no < stop""",
    "requirement_violations": """
WITH p AS (SELECT p_partkey AS k, CASE WHEN k % 11 = 0 THEN 'm.portal.example' WHEN k % 13 = 0 THEN 'otherportal.example' ELSE 'homes.example' END AS host, split_part(p_type, ' ', 2) AS kind, p_size * 5.0::DOUBLE AS area, p_retailprice AS price FROM part),
v AS (SELECT k, CASE WHEN host = 'portal.example' OR ends_with(host, '.portal.example') THEN 'portal' WHEN k % 3 <> 0 AND k % 17 = 0 THEN 'operacion' WHEN k % 4 <> 0 AND kind <> '' AND lower(kind) NOT IN ('brushed', 'plated') THEN 'tipo'
  WHEN k % 5 <> 0 AND area <= 55 THEN 'superficie' WHEN k % 7 <> 0 AND k % 5 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END < 2 THEN 'dormitorios' WHEN k % 6 <> 0 AND k % 50 > 40 THEN 'antiguedad' WHEN k % 8 <> 0 AND price > 1500 THEN 'precio' END AS violation FROM p)
SELECT k AS p_partkey, violation, coalesce(violation NOT IN ('portal', 'operacion', 'tipo', 'zona'), true) AS in_market FROM v""",
    "alert_predicate": """
SELECT p_partkey, NOT (p_partkey % 5 <> 0 AND p_partkey % 7 = 0) AND p_partkey % 3 <> 0 AND (p_size >= 35 OR (p_partkey % 4 <> 0 AND p_size + 15 >= 35)) AS alert, p_partkey % 7 <> 0 AND p_size >= 35 AS plain FROM part""",
    "board_columns": """
WITH o AS (SELECT o_orderkey, o_orderkey AS k, o_totalprice AS p, CAST(o_orderdate AS TIMESTAMP) AS t, CAST(o_orderdate AS DATE) AS d, round(o_totalprice, 0) AS q, round_even(round(o_totalprice, 0) * (1 + (o_orderkey % 5 - 2) / 10.0::DOUBLE), 0) AS b FROM orders),
f AS (SELECT *, CASE WHEN k % 4 <> 0 THEN epoch(TIMESTAMP '1998-08-01 12:00:00') - epoch(t) END AS s, (k % 40) * 25.25::DOUBLE AS a, DATE '1992-06-01' - d AS ago FROM o)
SELECT o_orderkey, k % 101 = 0 OR coalesce(s <= 86400, false) AS is_new, k % 3 = 0 AND DATE '1998-08-01' - d <= 1 AS dropped,
  CAST(CASE WHEN k % 4 <> 0 THEN greatest(0, floor(s / 86400)) WHEN k % 8 <> 0 THEN DATE '1998-08-01' - d END AS INTEGER) AS days,
  CASE WHEN k % 9 = 0 THEN '—' ELSE '$' || replace(format('{:,}', CAST(round_even(p, 0) AS BIGINT)), ',', '.') END AS pesos,
  replace(format('{:,}', CAST(floor(a) AS BIGINT)), ',', '.') || CASE CAST(round((a - floor(a)) * 100) AS INTEGER) WHEN 0 THEN '' WHEN 25 THEN ',25' WHEN 50 THEN ',5' ELSE ',75' END || ' m2' AS area,
  CASE WHEN ago >= 30 THEN 'Ya estuvo publicado hace ' || ago // 30 || ' mes(es)' || CASE WHEN b <> q THEN ', a $' || replace(format('{:,}', CAST(b AS BIGINT)), ',', '.') || ' (' || CASE WHEN q >= b THEN '+' ELSE '' END || CAST(round_even(100 * (q - b) / b, 0) AS INTEGER) || '%)' ELSE '' END ELSE '' END AS returned FROM f""",
    "listing_codes": """
WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '108' || c_custkey WHEN 1 THEN 'MPB' || c_custkey || 'A2' WHEN 2 THEN CAST(c_custkey AS VARCHAR) END AS code, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN c_custkey >= 100 WHEN 2 THEN c_custkey >= 1000 END AS ok FROM customer)
SELECT c_custkey, CASE WHEN ok THEN code END AS code FROM c""",
    "run_statistics": """
WITH e AS (SELECT event_type || '-' || user_id % 9 AS source, ts FROM events), n AS (SELECT source, count(*) AS n FROM e WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-15 02:00:00' GROUP BY source)
SELECT source, coalesce(n, 0) AS n, n IS NULL AS silent, n IS NULL AND source IN (SELECT source FROM e WHERE ts < TIMESTAMP '2024-01-15') AS went_silent FROM (SELECT DISTINCT source FROM e) LEFT JOIN n USING (source)""",
    "card_extraction": """
SELECT CAST(c_custkey AS BIGINT) AS page_id, CASE c_custkey % 4 WHEN 0 THEN 'linked-data' WHEN 1 THEN 'embedded-state' ELSE 'card' END AS via, 'https://homes.example/ficha/' || c_custkey AS url,
  CASE c_custkey % 4 WHEN 0 THEN 'Piso' WHEN 1 THEN 'Con vista' END AS title, CASE WHEN c_custkey % 4 <> 2 THEN CAST(c_custkey % 7 * 1000 + 250000 AS DOUBLE) END AS price, CAST(c_custkey % 90 + 40 AS DOUBLE) AS total,
  CAST(c_custkey % 5 + 1 AS INTEGER) AS bedrooms, CASE WHEN c_custkey % 4 = 2 THEN CAST(c_custkey % 3 + 1 AS INTEGER) END AS baths FROM customer WHERE c_custkey % 4 <> 3""",
    "rate_lookup": """
WITH r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal * 10 END AS a, abs(s_acctbal) * 7 AS b FROM supplier)
SELECT s_suppkey, round_even(CASE WHEN a BETWEEN 20000 AND 100000 THEN a WHEN b BETWEEN 20000 AND 100000 THEN b ELSE 40800 END, 2) AS value, CASE WHEN a BETWEEN 20000 AND 100000 THEN 'env' WHEN b BETWEEN 20000 AND 100000 THEN 'cache' ELSE 'constant' END AS origin FROM r""",
}

QUERIES = {name: globals()[name] for name in [*ORACLES, "five_pass_dedup"]} | pages.QUERIES | homes.QUERIES
ORACLES |= pages.ORACLES | homes.ORACLES
