"""Registered queries of addresses, buildings and what pages say, and their SQL, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import streets
from ..operators import buildings
from ..sources import lines, listings

AS_OF = "1998-08-02"
TOWNS = [f"NATION_{k}" for k in range(25)]
_LINE_WORDS = ("the ", "mente", "ung[ .]", "[0-9]", "©")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an address in one of twelve spellings, and their nation as the place, unknown for some."""
    k, town = F.col("c_custkey"), F.col("n_name")
    n = (k % 40 * 25).cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    spellings = [
        say("Calle Los Olmos Nº ", n), say("Los Olmos ", town, " ", n, ", ", town, ", Región Metropolitana"), say("Av. ", town, " ", n), town, say("Edificio de ", n), F.lit("Candelaria Goyenechea"),
        say(town, ", Metropolitana"), F.lit(None).cast("string"), say("Pasaje El Sol 1.", n), say(town, " 312 Metropolitana Juan XXIII ", n), F.lit("Aníbal Pinto, Region Metropolitana"), say("Juan de Dios ", n, ", Chile, Provincia de Santiago, CHL"),
    ]
    c = _table(spark, sf_dir, "customer").join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.get(F.array(*spellings), (F.floor(k / 40) % 12).cast("int")).alias("address"), F.when(k % 17 != 0, town).alias("place"))


def street_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _spelt(spark, sf_dir)
    return a.select("c_custkey", streets.street_key(F.col("address"), F.col("place"), TOWNS).alias("key"), streets.door_key(F.col("address"), F.col("place"), TOWNS).alias("door"))


def shown_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _spelt(spark, sf_dir).withColumn("shown", streets.shown_address(F.col("address"), F.col("place"), TOWNS))
    return a.select("c_custkey", "shown", streets.map_query(F.col("shown"), F.col("place"), "Chile", "Santiago").alias("map_query"))


def _buildings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as listings of a building for each customer, suppliers as what the ledger knew before."""
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("s_suppkey")
    address = F.when(k % 11 == 0, None).when(k % 13 == 0, "Los Olmos").otherwise(F.concat(F.lit("Calle Los Olmos Nº "), (c + 100).cast("string")))
    year = F.when(k % 51 == 0, 1700).when(k % 3 == 0, 1950 + c % 70 + (k % 30 == 0).cast("int"))
    offers = _table(spark, sf_dir, "orders").select(
        k, streets.door_key(address, F.lit(None).cast("string")).alias("building"), year.cast("int").alias("built"), F.when(k % 5 == 0, 7).alias("age"), F.col("o_orderpriority").alias("source"), F.concat(F.lit("u"), k.cast("string")).alias("url")
    )
    old = F.when(s % 9 == 0, F.concat(F.lit("id "), (s + 44_000).cast("string"), F.lit(" las condes"))).otherwise(F.concat(F.lit("los olmos "), (s + 100).cast("string")))
    ledger = _table(spark, sf_dir, "supplier").select(
        old.alias("building"), F.when(s % 4 != 0, 1950 + s % 70).cast("int").alias("year"), F.when(s % 4 == 0, F.array(F.lit(1990), F.lit(1991))).alias("disputed"),
        F.when(s % 4 != 0, F.lit("ledger")).alias("source"), F.when(s % 4 != 0, F.lit("u")).alias("url"), F.lit("1998-01-01").cast("date").alias("noted"),
    )
    return offers, ledger


def building_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, ledger = _buildings(spark, sf_dir)
    done = buildings.learn(ledger, offers, "o_orderkey", F.to_date(F.lit(AS_OF)))
    return done.select("building", "year", F.array_join("disputed", ",").alias("disputed"), "source", F.col("noted").cast("string").alias("noted"))


def building_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, ledger = _buildings(spark, sf_dir)
    as_of = F.to_date(F.lit(AS_OF))
    return buildings.answer(offers, buildings.learn(ledger, offers, "o_orderkey", as_of), as_of).select("o_orderkey", "built", "age", "from_ledger")


def page_data_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.data_lines(_table(spark, sf_dir, "pages"), "page_id", "html", _LINE_WORDS).select("page_id", "line")


def rows_with_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    values = [F.when(k % 2 == 0, k % 6), F.when(k % 5 == 0, F.col("o_totalprice"))]
    url = F.concat(F.lit("https://homes.example/"), F.when(k % 7 == 0, "ficha/").otherwise("indice-"), k.cast("string"))
    says = listings.has_content(values, [F.when(k % 9 == 0, F.when(k % 18 == 0, "").otherwise("Calle 1"))], [F.when(k % 11 == 0, 0.0)], url, "/ficha/[0-9]+")
    return _table(spark, sf_dir, "orders").where(says).select("o_orderkey")


_SPELT_SQL = """
a AS (SELECT c_custkey, c_custkey // 40 % 12 AS f, c_custkey % 40 * 25 AS n, n >= 100 AS high, n_name AS t, CASE WHEN c_custkey % 17 <> 0 THEN n_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_LEDGER_SQL = f"""
l AS (SELECT o_orderkey AS k, CASE WHEN k % 11 <> 0 AND k % 13 <> 0 THEN 'los olmos ' || (o_custkey + 100) END AS building, CASE WHEN k % 51 = 0 THEN 1700 WHEN k % 3 = 0 THEN 1950 + o_custkey % 70 + CAST(k % 30 = 0 AS INTEGER) END AS built, CASE WHEN k % 5 = 0 THEN 7 END AS age, o_orderpriority AS source FROM orders),
g AS (SELECT 'los olmos ' || (s_suppkey + 100) AS building, s_suppkey % 4 = 0 AS annulled, CASE WHEN s_suppkey % 4 <> 0 THEN 1950 + s_suppkey % 70 END AS year FROM supplier WHERE s_suppkey % 9 <> 0),
t AS (SELECT building, built, min(k) AS o, arg_min(source, k) AS source FROM l WHERE building IS NOT NULL AND built BETWEEN 1900 AND 2001 GROUP BY ALL),
u AS (SELECT building, arg_min(built, o) AS y1, arg_min(source, o) AS s1 FROM t GROUP BY building),
b AS (SELECT coalesce(g.building, u.building) AS building, g.building IS NULL AS fresh, annulled, CASE WHEN g.building IS NULL THEN y1 ELSE year END AS before, s1 FROM g FULL JOIN u ON g.building = u.building),
x AS (SELECT b.building, arg_min(t.built, t.o) AS other FROM b JOIN t ON t.building = b.building AND t.built <> before GROUP BY ALL),
ledger AS (
  SELECT building, CASE WHEN other IS NULL THEN CAST(before AS INTEGER) END AS year, CASE WHEN other IS NOT NULL THEN before || ',' || other WHEN annulled THEN '1990,1991' END AS disputed,
    CASE WHEN other IS NOT NULL OR annulled THEN NULL WHEN fresh THEN s1 ELSE 'ledger' END AS source, CASE WHEN other IS NOT NULL OR fresh THEN '{AS_OF}' ELSE '1998-01-01' END AS noted
  FROM b LEFT JOIN x USING (building)
)"""

ORACLES = {
    "street_keys": f"""
WITH {_SPELT_SQL}, k AS (
  SELECT *, lower(t) AS low, CASE f WHEN 0 THEN CASE WHEN high THEN 'los olmos ' || n END WHEN 1 THEN CASE WHEN high THEN CASE WHEN place IS NULL THEN 'los olmos ' || low || ' ' || n || ' ' || low ELSE 'los olmos ' || n END END
    WHEN 2 THEN CASE WHEN high THEN low || ' ' || n END WHEN 5 THEN 'candelaria goyenechea' WHEN 8 THEN CASE WHEN n > 0 THEN 'el sol 1' || n END
    WHEN 9 THEN CASE WHEN place IS NULL THEN low || ' ' ELSE '' END || '312 metropolitana juan xxiii ' || n WHEN 10 THEN 'anibal pinto' WHEN 11 THEN CASE WHEN high THEN 'juan de dios ' || n || ' chile' END END AS key FROM a
) SELECT c_custkey, coalesce(key, '') AS key, CASE WHEN f NOT IN (5, 10) THEN key END AS door FROM k""",
    "shown_addresses": f"""
WITH {_SPELT_SQL}, s AS (
  SELECT *, coalesce(CASE f WHEN 5 THEN 'Candelaria Goyenechea' WHEN 10 THEN 'Aníbal Pinto' WHEN 8 THEN CASE WHEN n > 0 THEN 'Pasaje El Sol 1.' || n END ELSE CASE WHEN high THEN
    CASE f WHEN 0 THEN 'Calle Los Olmos Nº ' || n WHEN 1 THEN 'Los Olmos ' || t || ' ' || n || ', ' || t WHEN 2 THEN 'Av. ' || t || ' ' || n WHEN 9 THEN 'Juan XXIII ' || n WHEN 11 THEN 'Juan de Dios ' || n || ', Chile' END END END, '') AS shown FROM a
) SELECT c_custkey, shown, CASE WHEN shown = '' THEN '' ELSE shown || ', ' END || CASE WHEN f = 1 AND shown <> '' AND place IS NOT NULL THEN '' ELSE coalesce(place, 'Santiago') || ', ' END || 'Chile' AS map_query FROM s""",
    "building_ledger": f"WITH {_LEDGER_SQL} SELECT * FROM ledger",
    "building_years": f"""
WITH {_LEDGER_SQL} SELECT k AS o_orderkey, CAST(coalesce(built, year) AS INTEGER) AS built, CAST(CASE WHEN built IS NULL AND year IS NOT NULL THEN coalesce(age, greatest(0, 1998 - year)) ELSE age END AS INTEGER) AS age,
  built IS NULL AND year IS NOT NULL AS from_ledger FROM l LEFT JOIN ledger USING (building)""",
    "page_data_lines": f"""
WITH v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', chr(10), 'g'), '(?is)<script[ >].*?</script>', chr(10), 'g'), '(?is)<style[ >].*?</style>', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g') AS body FROM pages),
d AS (SELECT page_id, replace(replace(replace(replace(body, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS body FROM v),
n AS (SELECT page_id, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM d),
m AS (SELECT page_id, pos, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS line FROM n)
SELECT page_id, arg_min(line, pos) AS line FROM m WHERE length(line) BETWEEN 3 AND 160 AND regexp_matches(line, '(?i){"|".join(_LINE_WORDS)}') GROUP BY page_id, lower(line)""",
    "rows_with_content": "SELECT o_orderkey FROM (SELECT *, o_orderkey AS k FROM orders) WHERE (k % 2 = 0 AND k % 6 <> 0) OR (k % 5 = 0 AND o_totalprice <> 0) OR (k % 9 = 0 AND k % 18 <> 0) OR k % 11 = 0 OR k % 7 = 0",
}

QUERIES = {name: globals()[name] for name in ORACLES}
