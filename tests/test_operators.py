"""Entity, state, source and streaming operators on small tables."""

import datetime
import json

from pyspark.sql import functions as F

from hearthgrid.operators import entities, market, state
from hearthgrid.sources import listings, tables
from hearthgrid.streaming.absence import market_events


def test_collapse_keeps_price_and_fills_the_rest(spark):
    df = spark.createDataFrame([(1, "g", 70, 900.0, None, "x"), (2, "g", 80, 800.0, None, ""), (3, "g", 10, 700.0, 5.0, "y"), (4, "h", 1, None, None, None)], "id int, g string, score int, price double, area double, label string")
    out = {r["g"]: r for r in entities.collapse(df, "g", [F.desc("score"), F.asc("id")], ["area", "label"], F.col("id").cast("string")).collect()}
    assert (out["g"]["id"], out["g"]["price"], out["g"]["area"], out["g"]["label"], out["g"]["copies"], out["g"]["also_in"]) == (2, 800.0, 5.0, "x", 3, "1,3")
    assert out["h"]["copies"] == 1 and entities.collapse(df.limit(0), "g", [F.desc("score")], ["area"]).count() == 0


def test_unit_groups(spark):
    df = spark.createDataFrame([(1, "g", "802", 5.0), (2, "g", "1204", 6.0), (3, "g", None, 6.0), (4, "g", None, 7.0), (5, None, None, 1.0), (6, None, None, 1.0), (7, "h", None, 1.0), (8, "h", "1", 2.0)], "_ord int, g string, unit string, price double")
    got = {r["_ord"]: r["entity"] for r in entities.unit_groups(df, "g", "unit", "price").collect()}
    assert got == {1: "g|802", 2: "g|1204", 3: "g|1204", 4: "row|4", 5: "row|5", 6: "row|6", 7: "h", 8: "h"}


def test_a_block_has_one_principal_that_moves_to_the_winner(spark):
    """Each point is 93 m from the next: 1 joins 0, and the others are too far from 0, which stays the principal."""
    df = spark.createDataFrame([(k, 1, k, -33.0, -70.0 + 0.001 * k, 3.0, 0, "x") for k in range(5)], "id int, b int, o int, lat double, lon double, beds double, score int, near string")
    run = lambda rows: {r["id"]: r["merged_into"] for r in entities.merge_into_principal(rows, ["b"], "id", ["o"], ["score"], entities.within("lat", "lon", 0.12, {"beds": 1})).collect()}
    assert run(df) == {0: None, 1: 0, 2: None, 3: None, 4: None}
    # each one ranks higher than the one before it, so the principal moves along and all end in the last
    assert run(df.withColumn("score", F.col("id"))) == {0: 1, 1: 2, 2: 3, 3: 4, 4: None}
    assert run(df.withColumn("beds", F.when(F.col("id") != 1, F.col("id") * 9.0))) == {0: None, 1: 0, 2: None, 3: None, 4: None}  # unknown speaks against nothing
    unknown = df.withColumn("lat", F.when(F.col("id") != 0, F.col("lat"))).withColumn("b", F.when(F.col("id") < 4, F.col("b")))
    assert run(unknown) == {0: None, 1: None, 2: None, 3: None, 4: None} and run(df.limit(0)) == {}


def test_broker_offers_of_one_code(spark):
    df = spark.createDataFrame([(1, "c", 80.0, 900.0, 2), (2, "c", 80.5, 500.0, 2), (3, "c", 60.0, 505.0, 2), (4, "c", 80.0, 905.0, 5), (5, None, 80.0, 900.0, 2), (6, "d", None, None, None)], "id int, code string, area double, price double, beds int")
    got = {r["id"]: r["merged_into"] for r in entities.merge_into_principal(df, ["code"], "id", ["id"], [], entities.same_offer("area", "price", {"beds": 1})).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None}


def test_twins_and_text_copies(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "a", 6), (4, None, 5), (5, "a", 5)], "id int, place string, price int")
    assert {r["id"]: (r["twin_of"], r["n_twins"]) for r in entities.twins(df, ["place", "price"], "id").collect()} == {1: (1, 2), 2: (1, 2), 5: (1, 2)}
    long_ = "ÁRBOL  y río " * 10
    rows = [(1, "s", long_), (2, "s", long_.lower()), (3, "t", long_), (4, "s", "short"), (5, "s", "short"), (6, "s", None), (None, "s", None), (None, "s", "short")]
    kept = entities.text_copies(spark.createDataFrame(rows, "id int, source string, text string"), "source", "text", "id").collect()
    assert sorted(str(r["id"]) for r in kept) == sorted(map(str, [1, 3, 4, 5, 6, None, None]))


def test_prior_event_of_another_identity(spark):
    rows = [(1, "a", "x", "alta"), (2, "a", "x", "precio"), (3, "a", "y", "alta"), (4, "a", "y", "alta"), (5, "a", "y", "precio"), (6, "a", "x", "baja"), (7, "b", "x", "alta"), (8, None, "x", "alta"), (9, None, "y", "alta"), (10, "a", "x", "alta"), (11, "a", "x", "alta")]
    df = spark.createDataFrame(rows, "t int, place string, fp string, event string")
    got = {r["t"]: r["prior"] for r in state.latest_prior(df, "place", ["t"], F.col("event") == "alta", "fp", "t").collect()}
    assert got == {1: None, 2: None, 3: 1, 4: 1, 5: 1, 6: 4, 7: None, 8: None, 9: None, 10: 4, 11: 4}


def test_price_trend(spark):
    day = datetime.date(2026, 1, 1)
    cases = {(100.0, 90.0, 80.0): (-20, 2, 31), (100.0, 80.0, 100.0): (None, None, None), (0.0, 100.0, 110.0): (10, 0, 31), (100.0,): (None, None, None), (): (None, None, None), (None, 200.0, 0.0, 100.0): (-50, 1, 31)}
    df = spark.createDataFrame([(i, list(p), [day] * len(p)) for i, p in enumerate(cases)], "i int, p array<double>, d array<date>")
    trend = state.price_trend(F.col("p"), F.col("d"), F.lit(datetime.date(2026, 2, 1)))
    assert [tuple(r)[1:] for r in df.select("i", *[c.alias(k) for k, c in trend.items()]).orderBy("i").collect()] == list(cases.values())


def test_lookup_takes_the_last_of_repeated_state_rows(spark):
    held = spark.createDataFrame([("k", "u", "old", 1), ("k", "u", "new", 2), ("z", "v", "z", 1)], "fp string, url string, label string, seq int")
    df = spark.createDataFrame([("k", "x", None), ("q", "v", None), ("q", "u", None), ("k", "x", "own")], "fp string, url string, label string")
    got = [tuple(r) for r in state.tiered_lookup(df, held, [["fp"], ["url"]], ["label"], "seq").collect()]
    assert sorted(got, key=repr) == sorted([("k", "x", "new", 1), ("q", "v", "z", 2), ("q", "u", None, None), ("k", "x", "own", 1)], key=repr)


def test_departures_of_live_runs(spark):
    rows = [("s", "a", 1), ("s", "b", 2), ("s", "b", 3), ("s", "b", 9), ("s", "b", 10), ("s", "b", 10), ("s", "a", 10), ("t", "c", 1)]
    got = {tuple(r) for r in state.departures(spark.createDataFrame(rows, "src string, key string, run int"), "src", "key", "run").collect()}
    assert got == {("s", "a", 9)}  # live runs of s are 1, 2, 3, 9 and 10


def test_summary_keeps_its_first_day_and_fees_of_zero_are_unknown(spark):
    days = [datetime.date(2026, 1, d) for d in (1, 2, 10, 11)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)] + [(days[2], 8.0), (days[2], 9.0)], "day date, v double")
    out = market.trailing_summary(df, "day", F.lit(datetime.date(2026, 1, 10)), 8, {"n": F.lit(True), "big": F.col("v") > 5}, {"m": F.col("v"), "few": F.when(F.col("v") > 1, F.col("v"))}).first()
    assert tuple(out) == (4, 2, 5.0, None)
    fees = spark.createDataFrame([(0.0, 10.0)] * 4 + [(100_000.0, None)] * 2 + [(120_000.0, 0.0)] * 2, "fee double, area double")
    assert fees.agg(market.typical_fee(F.col("fee"), F.col("area"), 130.0)).first()[0] == 110_000
    assert fees.where("area is null or fee = 0").agg(market.typical_fee(F.col("fee"), F.col("area"), 130.0)).first()[0] is None


def test_absence_counts_runs_of_live_sources(spark):
    s = spark.createDataFrame([("a", "s1", 2), ("b", "s1", 1), ("c", "s2", 2), ("d", "s1", 3)], "fp string, src string, missed int")
    out = state.count_absences(s, spark.createDataFrame([("b",)], "fp string"), spark.createDataFrame([("s1",)], "src string"), "fp", "src", "missed")
    assert {r["fp"]: (r["missed"], r["gone"]) for r in out.collect()} == {"a": (3, True), "b": (0, False), "c": (2, False), "d": (4, False)}


def test_streaming_events_equal_batch_semantics(spark, tmp_path):
    runs = [("a", 1, True, 10.0), ("a", 2, True, 9.0), ("a", 3, False, None), ("a", 4, False, None), ("a", 5, False, None), ("a", 6, False, None), ("b", 2, False, None), ("b", 3, True, 1.0)]
    schema = "key string, run long, seen boolean, price double"
    for i, part in enumerate((runs[:3], runs[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = market_events(stream).writeStream.format("memory").queryName("events_out").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["key"], r["run"], r["event"]) for r in spark.table("events_out").collect()}
    assert got == {("a", 1, "alta"), ("a", 2, "precio"), ("a", 5, "baja"), ("b", 3, "alta")}


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([(1, '{"k": 5}'), (2, ""), (3, '{"k":'), (4, None), (5, '{"other": 1}')], "seq int, line string")
    assert [(r["seq"], r["k"]) for r in tables.json_lines(lines, "line", "k int").orderBy("seq").collect()] == [(1, 5), (5, None)]
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    raw = spark.createDataFrame([(bytearray('<meta charset="latin1"><p>ñandú'.encode("latin-1")),), (bytearray("ñ".encode()),)], "content binary")
    assert [r["html"][-1] for r in tables.decode_pages(raw).collect()] == ["ú", "ñ"]


LD = {"@type": "ItemList", "itemListElement": [{"@type": "Apartment", "@id": "/ficha/501", "name": "Luminoso", "address": {"streetAddress": "Los Olmos 2310", "addressLocality": "Providencia"}, "floorSize": {"value": 91}, "numberOfBedrooms": 2, "offers": {"price": "990000", "priceCurrency": "CLP"}, "geo": {"latitude": -33.431, "longitude": -70.61}}, {"@type": "Organization", "name": "x"}]}
STATE = {"props": {"listings": [{"url": "/unidad/88", "title": "Con vista", "precio": 1240000, "comuna": {"nombre": "Macul"}, "dormitorios": 2, "superficieTotal": 77}], "config": {"price": 1, "currency": "CLP"}}}
CARDS = '<nav><a href="/menu/1">$ 1</a></nav><div><article><a href="/ficha/31"><img></a><a href="/ficha/31">Piso alto</a> $1.110.000 95 m² totales 2 dormitorios 2 baños</article><article><a href="/ficha/32">Interior</a> $ 700.000 61 m² 1 dormitorio 1 baño y más texto</article></div>'


def test_extraction_cascade(spark):
    pages = [(1, f'<script type="application/ld+json">{json.dumps(LD)}</script>{CARDS}'), (2, f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(STATE)}</script>'), (3, f'<script type="application/ld+json">{{broken</script>{CARDS}'), (4, None), (5, "")]
    df = spark.createDataFrame([(i, "https://ejemplo.cl/arriendo", h) for i, h in pages], "page_id long, url string, html string")
    rows = listings.assemble(listings.extract(df)).orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["via"], r["url"]) for r in rows] == [(1, "linked-data", "https://ejemplo.cl/ficha/501"), (2, "embedded-state", "https://ejemplo.cl/unidad/88"), (3, "card", "https://ejemplo.cl/ficha/31"), (3, "card", "https://ejemplo.cl/ficha/32")]
    assert (rows[0]["price"], rows[0]["total"], rows[0]["bedrooms"], rows[0]["place"], rows[0]["lat"]) == (990000, 91, 2, "Providencia", -33.431)
    assert (rows[1]["price"], rows[1]["place"], rows[1]["total"]) == (1240000, "Macul", 77)
    assert (rows[2]["bedrooms"], rows[2]["baths"], rows[2]["total"]) == (2, 2, 95)
