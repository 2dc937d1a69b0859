"""Registered queries of detail pages, links, coordinates and their SQL, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts
from ..operators import enrich, geocode
from ..sources import detail, enclosing, microdata

LAT0, LON0 = -33.381591, -70.562037
AS_OF = "2026-08-21"
_READ = enrich.Reading(("age", "built", "fees", "total", "floor", "bedrooms", "baths", "place", "address"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(c: dict[str, Column]) -> list[Column]:
    return [v.alias(k) for k, v in c.items()]


def _known(k: Column, n: int, c: Column) -> Column:
    return F.when(k % n != 0, c)


def detail_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as listings, orders as what their pages and others' gave, customers of other numbers as the pages' texts."""
    o, k, none = F.col("o_orderkey"), F.col("c_custkey"), F.lit(None)
    site = lambda n: F.concat(F.lit("https://www.homes.example/aviso/"), n.cast("string"), F.lit("/?ref=x"))
    c = _table(spark, sf_dir, "customer")
    listings = c.select(*_named({
        "c_custkey": k, "url": _known(k, 13, site(k)), "direct": k % 11 != 0, "lat": _known(k, 7, LAT0 + (k % 101 - 50) / 1000), "lon": _known(k, 7, LON0 + (k % 89 - 44) / 1000),
        "price": F.when(k % 6 != 0, F.col("c_acctbal") + 10_000), "price_uf": none.cast("double"), "age": F.when(k % 5 == 0, (k % 40).cast("int")), "built": none.cast("int"), "fees": none.cast("double"), "total": F.when(k % 3 == 0, k % 90 + 40.0),
        "floor": none.cast("int"), "bedrooms": _known(k, 4, (k % 3).cast("int")), "baths": _known(k, 2, (k % 2).cast("int")), "place": F.concat(F.lit("Ñuñoa "), (F.col("c_nationkey") % 3).cast("string")), "address": F.when(k % 9 == 0, " "),
    }))
    page = o % (4 * c.select(F.max("c_custkey")).scalar())
    candidates = _table(spark, sf_dir, "orders").select(*_named({
        "page_url": F.concat(F.lit("http://homes.example/aviso/"), page.cast("string")), "url": F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("HTTPS://homes.example/aviso/"), page.cast("string"), F.lit("#x"))).otherwise(site(page + 1)), "pos": o,
        "price": _known(o, 3, F.col("o_totalprice")), "price_uf": F.when(o % 3 == 0, F.lit(0.0)), "age": F.when(F.col("o_custkey") % 3 == 0, (o % 50).cast("int")), "built": _known(o, 4, (o % 60 + 1960).cast("int")), "fees": _known(o, 5, o % 100 * 1000.0),
        "total": _known(F.col("o_custkey"), 5, o % 80 + 30.0), "floor": F.when(o % 7 == 0, (o % 20).cast("int")), "bedrooms": _known(F.col("o_custkey"), 4, (o % 3).cast("int")), "baths": _known(F.col("o_custkey"), 3, (o % 2).cast("int")), "place": F.when(o % 8 == 0, "nunoa 1"), "address": F.when(o % 6 == 0, "Calle 1").when(o % 6 == 1, ""),
    }))
    texts = c.select(*_named({
        "page_url": F.concat(F.lit("https://homes.example/aviso/"), (k + 1).cast("string")), "anchored": k % 3 == 0, "price": F.when(k % 2 == 0, k * 10.0), "price_uf": none.cast("double"), "age": F.when(k % 4 == 0, (k % 30).cast("int")), "built": none.cast("int"), "fees": k % 70 * 1000.0,
        "total": k % 60 + 20.0, "floor": F.when(k % 5 == 0, (k % 15).cast("int")), "bedrooms": (k % 4).cast("int"), "baths": none.cast("int"), "place": none.cast("string"), "address": none.cast("string"),
    }))
    pins = c.where(k % 14 == 0).select(F.concat(F.lit("homes.example/aviso/"), k.cast("string")).alias("page_url"), F.lit(LAT0).alias("lat"), F.lit(LON0).alias("lon"))
    done = enrich.enrich(listings, candidates, texts, pins, _READ)
    origin = F.array_join(F.array_sort(F.transform(F.map_entries("origin"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return done.select("c_custkey", "enriched", "price", "age", "built", "fees", "total", "floor", "bedrooms", "baths", "address", F.bround("lat", 6).alias("lat"), origin.alias("origin"))


def detail_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four kinds made of customers: a sheet before the title, prose only, cut at the address, and without either."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    sheet = F.concat(F.lit("<head><style>p{}</style></head><nav>3 dormitorios</nav> <div>Precio convertido: $ 1."), s(k % 900 + 100), F.lit(".000 · "), s(k % 4 + 3), F.lit(" Habitaciones <b>"), s(k % 3 + 2), F.lit(" baños</b> · Año de construcción: "), s(k % 30 + 1990), F.lit("</div>"))
    title = F.concat(F.lit("Departamento luminoso de Nº "), s(k))
    prose = F.concat(F.lit("<p>Tiene 2 dormitorios y 1 baño, superficie total "), s(k % 90 + 40), F.lit(" m2, gastos comunes $ "), s(k % 80 + 20), F.lit(".000</p><script>9 dormitorios</script>"))
    place = F.concat(F.lit("Avenida Larga "), s(k % 500 + 1000))
    html = F.when(k % 4 == 0, F.concat(sheet, F.lit("<h1>"), title, F.lit("</h1>"), prose)).when(k % 4 == 1, F.concat(F.lit("<h1>"), title, F.lit("</h1>"), prose)).when(k % 4 == 2, F.concat(F.lit("<b>5 dormitorios</b> en "), place, prose)).otherwise(prose)
    c = _table(spark, sf_dir, "customer").select(k, F.concat(F.lit("https://homes.example/aviso/"), s(k)).alias("url"), F.upper(title).alias("title"), F.concat(place, F.lit(", Chile")).alias("address"), html.alias("html"))
    pages = c.select("url", "html").withColumnRenamed("url", "page_url")
    said = detail.text_readings(pages, c, F.to_date(F.lit(AS_OF)))
    return said.select(F.regexp_extract("page_url", "([0-9]+)$", 1).cast("long").alias("c_custkey"), "anchored", "price", "fees", "built", "age", "total", "bedrooms", "baths")


def enclosing_link_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' parts as list pages of ten rows: a card for each, of which some share a block with their neighbour."""
    k, s = F.col("p_partkey"), lambda c: c.cast("string")
    p = _table(spark, sf_dir, "part").select(k, ((k - 1) / 10).cast("long").alias("page_id"), F.concat(F.lit("https://homes.example/ficha/"), s(k)).alias("url"), F.lit("https://homes.example/lista").alias("base"), F.when(k % 5 == 0, F.col("p_retailprice")).alias("price"), F.lit(None).cast("double").alias("fees"))
    money = F.concat(F.lit("arriendo $ "), s(k % 900 + 100), F.lit(".000"), F.when(k % 4 == 0, F.concat(F.lit(", gastos comunes $ "), s(k % 80 + 20), F.lit(".000"))).otherwise(""))
    link = F.concat(F.lit("<a href='/ficha/"), s(k), F.lit("?x=1'>ver</a>"))
    # the third of three leaves its price outside, in a block with the next card; the seventh's block is long
    card = F.when(k % 3 == 0, F.concat(F.lit("<li><p>"), link, F.lit("</p></li>"), money)).when(k % 7 == 0, F.concat(F.lit("<li>"), money, F.repeat(F.lit(" larga"), 120), link, F.lit("</li>"))).otherwise(F.concat(F.lit("<li><div><span>"), link, F.lit("</span></div><p>"), money, F.lit("</p></li>")))
    pages = p.select("page_id", k, card.alias("card")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x["card"]), "").alias("html"))  # ten cards
    return enclosing.fill_by_enclosing_link(p, pages, key="p_partkey").select("p_partkey", "price", "fees")


def microdata_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as list pages of five rows with microdata; a third of the pages has an item too many, and half of the sites state UF as pesos."""
    k, page, s = F.col("p_partkey"), F.col("page_id"), lambda c: c.cast("string")
    p = _table(spark, sf_dir, "part").select(k, ((k - 1) / 5).cast("long").alias("page_id"))
    rows = p.select(k, "page_id", F.lit("https://homes.example/lista").alias("url"), F.lit("https://homes.example/lista").alias("base"), F.when(k % 7 == 0, k * 1000.0).alias("price"), F.lit(None).cast("double").alias("price_uf"), (k % 11 == 0).alias("direct"), (page % 2 == 0).alias("in_uf"))
    stated = F.when(k % 4 == 0, s(k % 400 + 10)).when(k % 4 == 1, F.concat(F.lit("$ 1."), s(k % 900 + 100), F.lit(".000"))).when(k % 4 == 2, s(k % 9000 + 600)).otherwise("a convenir")
    link = F.when(k % 6 == 0, "/venta/x").otherwise(F.concat(F.lit("/ficha/"), s(k)))
    offer = F.when(k % 2 == 0, F.concat(F.lit("<meta itemprop='price' content='"), stated, F.lit("'>"))).otherwise(F.concat(F.lit("<b itemprop=price>"), stated, F.lit("</b>")))
    card = F.concat(F.lit("<div itemscope itemtype='https://schema.org/Product'><a href='"), link, F.lit("'>x</a><span itemprop='offers' itemtype='http://schema.org/Offer/'>"), offer, F.lit("</span></div>"))
    pages = p.select("page_id", k, card.alias("card")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "card"))), lambda x: x["card"]), "").alias("html"))  # five cards
    more = F.lit("<p itemtype='https://schema.org/Product'><i itemprop=price>9</i><p itemtype='https://schema.org/Offer'><i itemprop=price>9</i>")
    pages = pages.withColumn("html", F.when(page % 3 == 0, F.concat("html", more)).otherwise(F.col("html")))
    return microdata.fill_by_microdata(rows, pages, pos="p_partkey").select("p_partkey", "url", "price", "price_uf", "direct", "operation")


def labelled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of eight kinds made of orders."""
    k, s = F.col("o_orderkey"), lambda c: c.cast("string")
    a, g = k % 600 + 300, k % 80 + 20  # thousands
    kinds = [
        ("Arriendo $ ", a, ".000, gastos comunes $ ", g, ".000, garantía 2 meses"),
        ("Valor $1.", k % 800 + 100, ".000 + G.C. $", g, ".000"),
        ("Canon 1,", k % 9 + 1, " millones; Garantía: $ ", a, ".000"),
        ("Departamento por CLP ", a * 1000, ".00; GGCC $ ", g, ".000"),
        ("UF ", k % 90 + 10, " mensuales. Gastos comunes: UF ", k % 9 + 1, ",5"),
        ("*Gastos comunes: $ ", g, ".000 en verano y $ ", g + 300, ".000 en invierno"),
        ("*MPB*", a, ".605 se arrienda, valor promedio de arriendo $ ", a, ".000"),
        ("Precio de venta $ ", k % 90 + 50, ".000.000 | ", a, ".000 pesos"),
    ]
    texts = [F.concat(*[F.lit(p) if isinstance(p, str) else s(p) for p in kind]) for kind in kinds]
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*texts), (k % 8).cast("int")).alias("t")).withColumn("read", amounts.read_amounts(F.col("t")))
    return o.select("o_orderkey", *_named(amounts.money(F.col("read"))), F.size("read.found").alias("n"), F.array_join(F.transform("read.found", lambda x: F.coalesce(x["label"], F.lit("-"))), ",").alias("labels"))


def _geo(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Column]:
    """Customers as listings, suppliers as earlier answers, and the forms of a listing's address."""
    k, m = F.col("c_custkey"), F.col("m")
    n = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("town"))
    listings = _table(spark, sf_dir, "customer").select(k, F.col("c_nationkey").alias("nation"), F.when(k % 3 == 0, LAT0 + (k % 11) / 1000).alias("lat"), F.when(k % 3 == 0, LON0).alias("lon"), F.concat(F.lit("Calle. "), (k % 12).cast("string")).alias("street"))
    listings = listings.join(F.broadcast(n), "nation").withColumn("address", F.when(k % 8 == 0, "").otherwise(F.concat_ws(", ", "street", "town")))
    old = _table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 24).alias("d"), F.col("s_nationkey").alias("nation")).agg(F.min("s_suppkey").alias("m")).where("d < 12").join(F.broadcast(n), "nation")
    ago = F.date_sub(F.to_date(F.lit(AS_OF)), (m % 200).cast("int"))
    cache = old.select(*_named({
        "query": F.concat_ws(" ", F.lit("calle"), "d", F.lower("town")), "lat": F.when(m % 4 != 0, LAT0 + (m % 9) / 10), "lon": F.when(m % 4 != 0, F.lit(LON0)), "street": F.lit(None).cast("string"),
        "failed": F.when(m % 4 == 0, ago), "attempts": F.when(m % 4 == 0, (m % 5).cast("int")), "seen": ago,
    }))
    return listings, cache, F.array("address", F.concat(F.col("street"), F.lit(" ,, "), F.col("town"), F.lit(".")), F.col("town"))


def coordinate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings, cache, forms = _geo(spark, sf_dir)
    out, _ = geocode.locate(listings, cache, forms, (LAT0, LON0), key="c_custkey")
    return out.select("c_custkey", F.bround("lat", 6).alias("lat"), "geo_origin")


def geocode_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings, cache, forms = _geo(spark, sf_dir)
    return geocode.questions(listings, cache, forms, "c_custkey", F.to_date(F.lit(AS_OF)), key="c_custkey")


def geocode_cache_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after a run in which every form of a town's first streets was answered, for some towns with a miss."""
    listings, cache, forms = _geo(spark, sf_dir)
    _, used = geocode.locate(listings, cache, forms, None, key="c_custkey")
    n = F.col("nation")
    answers = listings.where(F.col("c_custkey") % 12 < 3).select(F.col("address").alias("query"), F.when(n % 2 == 0, LAT0 + n / 100).alias("lat"), F.when(n % 2 == 0, F.lit(LON0)).alias("lon"), F.lit(None).cast("string").alias("street"))
    return geocode.refreshed(cache, used, answers, F.to_date(F.lit(AS_OF))).select("query", F.bround("lat", 6).alias("lat"), F.col("failed").cast("string").alias("failed"), "attempts", F.col("seen").cast("string").alias("seen"))


_FIRST = "arg_min({0}, o) FILTER ({1} AND {0} IS NOT NULL)"
_DETAIL_FIELDS = ("age", "built", "fees", "total", "floor", "bedrooms", "baths", "place", "address")
_GEO_SQL = f"""
l AS (
  SELECT c_custkey, c_nationkey AS nation, CASE WHEN c_custkey % 3 = 0 THEN {LAT0} + (c_custkey % 11) / 1000.0::DOUBLE END AS lat, c_custkey % 12 AS d, lower(n_name) AS town, c_custkey % 8 <> 0 AS has FROM customer JOIN nation ON c_nationkey = n_nationkey
), k AS (
  SELECT 'calle ' || d || ' ' || lower(n_name) AS query, CASE WHEN m % 4 <> 0 THEN {LAT0} + (m % 9) / 10.0::DOUBLE END AS lat, CASE WHEN m % 4 = 0 THEN DATE '{AS_OF}' - CAST(m % 200 AS INTEGER) END AS failed,
    CASE WHEN m % 4 = 0 THEN CAST(m % 5 AS INTEGER) END AS attempts, DATE '{AS_OF}' - CAST(m % 200 AS INTEGER) AS seen
  FROM (SELECT s_suppkey % 24 AS d, s_nationkey, min(s_suppkey) AS m FROM supplier GROUP BY ALL) JOIN nation ON s_nationkey = n_nationkey WHERE d < 12
)"""

ORACLES = {
    "detail_enrichment": f"""
WITH mx AS (SELECT max(c_custkey) AS m FROM customer),
l AS (
  SELECT c_custkey AS k, c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 AS visit, CASE WHEN c_custkey % 7 <> 0 THEN {LAT0} + (c_custkey % 101 - 50) / 1000.0::DOUBLE END AS lat, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal + 10000 END AS price,
    CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 40 END AS age, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 90 + 40.0 END AS total, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 3 END AS bedrooms, CASE WHEN c_custkey % 2 <> 0 THEN c_custkey % 2 END AS baths,
    c_nationkey % 3 AS town FROM customer
), c AS (
  SELECT o_orderkey % (4 * m) AS page, o_custkey % 2 = 0 AS own, o_orderkey AS o, CASE WHEN o_orderkey % 3 <> 0 AND o_totalprice > 0 THEN o_totalprice END AS price, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 50 END AS age, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 60 + 1960 END AS built,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 * 1000.0 END AS fees, CASE WHEN o_custkey % 5 <> 0 THEN o_orderkey % 80 + 30.0 END AS total, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 20 END AS floor, CASE WHEN o_custkey % 4 <> 0 THEN o_orderkey % 3 END AS bedrooms,
    CASE WHEN o_custkey % 3 <> 0 THEN o_orderkey % 2 END AS baths, CASE WHEN o_orderkey % 8 = 0 THEN 1 END AS place, CASE WHEN o_orderkey % 6 = 0 THEN 'Calle 1' END AS address FROM orders, mx
), p AS (
  SELECT page, count(*) AS n, count(*) FILTER (own) AS n_own, {", ".join(f"{_FIRST.format(f, 'own')} AS o_{f}, {_FIRST.format(f, 'true')} AS a_{f}" for f in (*_DETAIL_FIELDS, "price"))} FROM c GROUP BY page
), t AS (
  SELECT c_custkey + 1 AS page, c_custkey % 3 = 0 AS anchored, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10.0 END AS price, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 30 END AS age, c_custkey % 70 * 1000.0 AS fees, c_custkey % 60 + 20.0 AS total,
    CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 15 END AS floor, c_custkey % 4 AS bedrooms FROM customer
), j AS (
  SELECT l.*, coalesce(n_own > 0, false) AS by_url, coalesce(n_own = 0 AND n = 1 AND NOT coalesce(a_place <> town, false) AND NOT coalesce(a_bedrooms <> l.bedrooms, false) AND NOT coalesce(a_baths <> l.baths, false), false) AS by_one,
    p.* EXCLUDE (page), t.page IS NOT NULL AND coalesce(n, 0) < 5 AS read, coalesce(anchored, false) AS anchored, t.price AS t_price, t.age AS t_age, t.fees AS t_fees, t.total AS t_total, t.floor AS t_floor, CASE WHEN NOT coalesce(t.bedrooms <> l.bedrooms, false) THEN t.bedrooms END AS t_bedrooms,
    coalesce(t.bedrooms <> l.bedrooms, false) AS clash
  FROM l LEFT JOIN p ON p.page = k AND visit LEFT JOIN t ON t.page = k AND visit
), s AS (
  SELECT *, by_url OR by_one AS mine, read AND (by_url OR by_one OR anchored OR NOT clash) AS usable, by_url OR by_one OR anchored AS whole FROM j
), f AS (
  SELECT k, visit, lat, price, age, total, bedrooms, baths, mine OR (usable AND (whole OR t_age IS NOT NULL)) AS enriched, CASE WHEN usable THEN t_age END AS t_age,
    {", ".join(f"CASE WHEN by_url THEN o_{f} WHEN by_one THEN a_{f} END AS m_{f}" for f in (*_DETAIL_FIELDS, "price"))},
    {", ".join(f"CASE WHEN usable AND whole THEN t_{f} END AS t_{f}" for f in ("fees", "total", "floor", "bedrooms", "price"))}, CASE WHEN k % 14 = 0 AND visit AND lat IS NULL THEN {LAT0} END AS pin FROM s
)
SELECT k AS c_custkey, enriched, coalesce(price, m_price, t_price) AS price, coalesce(age, m_age, t_age) AS age, m_built AS built, coalesce(m_fees, t_fees) AS fees, coalesce(total, m_total, t_total) AS total, coalesce(m_floor, t_floor) AS floor,
  coalesce(bedrooms, m_bedrooms, t_bedrooms) AS bedrooms, coalesce(baths, m_baths) AS baths, coalesce(m_address, CASE WHEN k % 9 = 0 THEN ' ' END) AS address, round_even(coalesce(lat, pin), 6) AS lat,
  array_to_string(list_sort(list_filter([
    CASE WHEN pin IS NOT NULL THEN 'lat=pin' END, CASE WHEN pin IS NOT NULL THEN 'lon=pin' END, CASE WHEN m_built IS NOT NULL THEN 'built=own' END, CASE WHEN m_address IS NOT NULL THEN 'address=own' END,
    CASE WHEN baths IS NULL AND m_baths IS NOT NULL THEN 'baths=own' END,
    {", ".join(f"CASE WHEN {own} IS NULL AND m_{f} IS NOT NULL THEN '{f}=own' WHEN {own} IS NULL AND t_{f} IS NOT NULL THEN '{f}=text' END" for f, own in (("price", "price"), ("age", "age"), ("fees", "NULL"), ("total", "total"), ("floor", "NULL"), ("bedrooms", "bedrooms")))}
  ], lambda x: x IS NOT NULL)), ',') AS origin
FROM f""",
    "detail_text": f"""
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_custkey % 4 <> 3 AS anchored, CASE WHEN c_custkey % 4 = 0 THEN 1000000.0 + (c_custkey % 900 + 100) * 1000 END AS price, (c_custkey % 80 + 20) * 1000.0 AS fees,
  CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 30 + 1990 END AS built, CASE WHEN c_custkey % 4 = 0 THEN year(DATE '{AS_OF}') - (c_custkey % 30 + 1990) END AS age, c_custkey % 90 + 40.0 AS total,
  CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 4 + 3 ELSE 2 END AS bedrooms, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 3 + 2 ELSE 1 END AS baths FROM customer""",
    "microdata_prices": """
WITH p AS (SELECT p_partkey AS k, CAST((p_partkey - 1) // 5 AS BIGINT) AS page FROM part),
v AS (SELECT *, page % 3 <> 0 AS fits, page % 2 = 0 AS uf, CASE k % 4 WHEN 0 THEN k % 400 + 10.0 WHEN 1 THEN 1000000.0 + (k % 900 + 100) * 1000 WHEN 2 THEN k % 9000 + 600.0 END AS n FROM p),
f AS (SELECT *, CASE WHEN fits AND k % 7 <> 0 THEN n END AS m, fits AND k % 11 <> 0 AND k % 6 <> 0 AS linked FROM v)
SELECT k AS p_partkey, CASE WHEN linked THEN 'https://homes.example/ficha/' || k ELSE 'https://homes.example/lista' END AS url,
  CASE WHEN k % 7 = 0 THEN k * 1000.0 WHEN m BETWEEN 250000 AND 20000000 THEN m WHEN uf AND m BETWEEN 5 AND 500 THEN round_even(m * 40800, 0) END AS price, CASE WHEN uf AND m BETWEEN 5 AND 500 THEN m END AS price_uf,
  linked OR k % 11 = 0 AS direct, CASE WHEN uf AND m > 500 AND m < 250000 THEN 'venta' END AS operation FROM f""",
    "labelled_amounts": """
WITH k AS (SELECT o_orderkey AS k, o_orderkey % 8 AS t, (o_orderkey % 600 + 300) * 1000.0 AS a, (o_orderkey % 80 + 20) * 1000.0 AS g FROM orders)
SELECT k AS o_orderkey,
  CASE t WHEN 0 THEN a WHEN 1 THEN 1000000.0 + (k % 800 + 100) * 1000 WHEN 2 THEN round(1000000.0 + (k % 9 + 1) * 100000) WHEN 3 THEN a WHEN 4 THEN (k % 90 + 10) * 40800.0 WHEN 7 THEN a END AS rent,
  CASE WHEN t = 4 THEN (k % 90 + 10) * 1.0 END AS rent_uf, CASE WHEN t IN (0, 1, 3, 5) THEN g WHEN t = 4 THEN round_even((k % 9 + 1.5) * 40800, 0) END AS fees, CASE WHEN t = 7 THEN (k % 90 + 50) * 1000000.0 END AS sale, CASE WHEN t = 0 THEN 2.0 END AS guarantee,
  CAST(CASE t WHEN 4 THEN 0 WHEN 6 THEN 1 ELSE 2 END AS INTEGER) AS n, CASE t WHEN 0 THEN 'rent,fees' WHEN 1 THEN '-,fees' WHEN 2 THEN 'rent,guarantee' WHEN 3 THEN '-,fees' WHEN 4 THEN '' WHEN 5 THEN 'fees,fees' WHEN 6 THEN 'statistic' ELSE 'sale,-' END AS labels FROM k""",
    "enclosing_link_prices": """
WITH p AS (SELECT p_partkey AS k, p_retailprice, p_partkey % 3 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 900 + 100 >= 250 AS own FROM part)
SELECT k AS p_partkey, CASE WHEN k % 5 = 0 THEN p_retailprice WHEN own THEN (k % 900 + 100) * 1000.0 END AS price, CASE WHEN k % 5 <> 0 AND own AND k % 4 = 0 THEN (k % 80 + 20) * 1000.0 END AS fees FROM p""",
    "coordinate_lookup": f"""
WITH {_GEO_SQL}
SELECT c_custkey, round_even(CASE WHEN l.lat IS NULL AND k.lat IS NOT NULL AND ok THEN k.lat ELSE l.lat END, 6) AS lat, CASE WHEN l.lat IS NULL AND k.lat IS NOT NULL AND ok THEN 'address' END AS geo_origin
FROM l LEFT JOIN (SELECT *, radians(abs(lat - {LAT0})) * 6371.0088 <= 40 AS ok FROM k) k ON has AND query = 'calle ' || d || ' ' || town""",
    "geocode_questions": f"""
WITH {_GEO_SQL}, o AS (SELECT l.*, k.lat AS hit, k.failed AS failed FROM l LEFT JOIN k ON query = 'calle ' || d || ' ' || town WHERE has AND l.lat IS NULL),
f AS (SELECT c_custkey, 0 AS place, 'calle ' || d || ' ' || town AS query FROM o WHERE hit IS NULL AND (failed IS NULL OR DATE '{AS_OF}' - failed >= 30) UNION ALL SELECT c_custkey, 2, town FROM o WHERE hit IS NULL),
q AS (SELECT query, min((c_custkey, place)) AS x FROM f GROUP BY query)
SELECT CAST(row_number() OVER (ORDER BY x) AS INTEGER) AS nth, query FROM q QUALIFY nth <= 25""",
    "geocode_cache_upkeep": f"""
WITH {_GEO_SQL}, a AS (SELECT DISTINCT 'calle ' || d || ' ' || town AS query, CASE WHEN nation % 2 = 0 THEN {LAT0} + nation / 100.0::DOUBLE END AS hit FROM l WHERE has AND d < 3),
u AS (SELECT DISTINCT query FROM l JOIN k ON query = 'calle ' || d || ' ' || town WHERE has AND l.lat IS NULL AND k.lat IS NOT NULL),
n AS (
  SELECT query, round_even(CASE WHEN a.query IS NULL THEN lat ELSE hit END, 6) AS lat, CASE WHEN a.query IS NULL THEN failed WHEN hit IS NULL THEN DATE '{AS_OF}' END AS failed,
    CASE WHEN a.query IS NULL THEN attempts WHEN hit IS NULL THEN CAST(coalesce(attempts, 0) + 1 AS INTEGER) END AS attempts, CASE WHEN a.query IS NOT NULL OR query IN (SELECT query FROM u) THEN DATE '{AS_OF}' ELSE seen END AS seen
  FROM k FULL JOIN a USING (query)
) SELECT query, lat, CAST(failed AS VARCHAR) AS failed, attempts, CAST(seen AS VARCHAR) AS seen FROM n WHERE DATE '{AS_OF}' - seen <= 180""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
