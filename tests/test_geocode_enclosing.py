"""Coordinates from earlier answers, and prices from the block around a listing's link."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthgrid.operators import geocode
from hearthgrid.sources import enclosing

DAY = dt.date(2026, 8, 21)
CACHE = "query string, lat double, lon double, street string, failed date, attempts int, seen date"


def days(n):
    return DAY - dt.timedelta(days=n)


def cache_of(spark, *rows):
    names = geocode.COLUMNS
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], CACHE)


LISTING = "id int, address string, place string, lat double, lon double"


@pytest.fixture(scope="module")
def known(spark):
    return cache_of(
        spark, {"query": "espoz 2620 vitacura", "lat": -33.39, "lon": -70.58, "seen": days(3)}, {"query": "espoz vitacura", "lat": -33.0, "lon": -70.0, "seen": days(9)},
        {"query": "lejos 1 arica", "lat": -18.4, "lon": -70.3, "seen": days(9)}, {"query": "nada 5", "failed": days(30), "attempts": 2, "seen": days(30)}, {"query": "nada 6", "failed": days(29), "attempts": 1, "seen": days(29)},
        {"query": "@-33 40000 -70 57000", "street": "Los Leones 10", "seen": days(1)}, {"query": "@-33 41000 -70 57000", "street": "", "failed": days(2), "attempts": 1, "seen": days(2)}, {"query": "vieja 1", "lat": 1.0, "lon": 1.0, "seen": days(181)}, {"query": "sin fecha", "lat": 1.0, "lon": 1.0},
    )


def test_one_entry_for_all_ways_to_write_it(spark):
    rows = spark.createDataFrame([(" Av. Espoz  2620,, Vitacura, ",), ("av espoz 2620 vitacura",), (" .,",)], "q string")
    assert [r[0] for r in rows.select(geocode.cache_key(F.col("q"))).collect()] == ["av espoz 2620 vitacura"] * 2 + [""]


def test_first_hit_by_specificity_and_plausibility(spark, known):
    rows = [(1, "Espoz 2620", "Vitacura", None, None), (2, "Espoz 99", "Vitacura", None, None), (3, "Lejos 1", "Arica", None, None), (4, "Espoz 2620", "Vitacura", 1.0, 2.0), (5, " ", "Vitacura", None, None), (6, "Otra 1", None, None, None), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, LISTING)
    forms = F.array(F.concat_ws(", ", "address", "place"), F.concat_ws(" ", F.split_part("address", F.lit(" "), F.lit(1)), "place"))
    out, used = geocode.locate(df, known, forms, (-33.38, -70.56))
    got = {r["id"]: (r["lat"], r["geo_origin"]) for r in out.collect()}
    assert got == {1: (-33.39, "address"), 2: (None, None), 3: (None, None), 4: (1.0, None), 5: (None, None), 6: (None, None), 7: (None, None)}
    assert sorted(r["query"] for r in used.collect()) == ["espoz 2620 vitacura", "espoz vitacura", "lejos 1 arica"]
    assert {r["id"]: r["lat"] for r in geocode.locate(df, known, forms)[0].collect()}[2] == -33.0


def test_questions_in_order_without_recent_misses_and_repeats(spark, known):
    rows = [(1, "Espoz 2620 Vitacura", 9), (2, "Nada 5", 5), (3, "NADA. 6", 4), (4, "Nueva 1", 8), (5, "nueva  1", 2), (6, "Nueva 2", 7)]
    df = spark.createDataFrame(rows, "id int, address string, o int").withColumn("lat", F.lit(None).cast("double"))
    forms = F.array("address", F.concat("address", F.lit(", Chile")))
    asked = geocode.questions(df, known, forms, "o", F.lit(DAY), most=5)
    assert [tuple(r) for r in asked.orderBy("nth").collect()] == [(1, "nueva 1"), (2, "nueva 1 chile"), (3, "nada 6 chile"), (4, "nada 5"), (5, "nada 5 chile")]


def test_streets_of_points(spark, known):
    rows = [(1, None, "Providencia", -33.4, -70.57), (2, "", None, -33.4, -70.57), (3, None, "x", -33.41, -70.57), (4, "Own 1", "x", -33.4, -70.57), (5, None, "x", None, None)]
    out, used = geocode.streets(spark.createDataFrame(rows, LISTING), known)
    assert {r["id"]: (r["address"], r["address_origin"]) for r in out.collect()} == {1: ("Los Leones 10, Providencia", "pin"), 2: ("Los Leones 10", "pin"), 3: (None, None), 4: ("Own 1", None), 5: (None, None)}
    assert sorted(r["query"] for r in used.collect()) == ["@-33 40000 -70 57000", "@-33 41000 -70 57000"]


def test_cache_after_a_run(spark, known):
    answers = spark.createDataFrame([("Nada 5", None, None, None), ("nada. 6", 5.0, 6.0, None), ("Nueva 1", None, None, None), ("@-33.41000,-70.57000", None, None, "Calle 3"), ("@1.00000,1.00000", None, None, None), (" ,", 1.0, 1.0, None)], "query string, lat double, lon double, street string")
    used = spark.createDataFrame([("espoz vitacura",)], "query string")
    got = {r["query"]: tuple(r)[1:] for r in geocode.refreshed(known, used, answers, F.lit(DAY)).collect()}
    assert set(got) == {"espoz 2620 vitacura", "espoz vitacura", "lejos 1 arica", "nada 5", "nada 6", "nueva 1", "@-33 40000 -70 57000", "@-33 41000 -70 57000", "@1 00000 1 00000", "sin fecha"}
    assert got["nada 5"] == (None, None, None, DAY, 3, DAY) and got["nada 6"] == (5.0, 6.0, None, None, None, DAY) and got["nueva 1"] == (None, None, None, DAY, 1, DAY)
    assert got["espoz vitacura"] == (-33.0, -70.0, None, None, None, DAY) and got["espoz 2620 vitacura"][-1] == days(3)
    assert got["@-33 41000 -70 57000"] == (None, None, "Calle 3", days(2), 1, DAY) and got["@1 00000 1 00000"] == (None, None, "", DAY, 1, DAY)


# --- enclosing links

BASE = "https://homes.example/lista"
ROWS = "page_id long, pos int, url string, base string, price double, fees double"


def filled(spark, html, *paths, **given):
    rows = [(1, i, p if p is None or p.startswith("http") else f"https://homes.example{p}", BASE, given.get(f"p{i}"), None) for i, p in enumerate(paths)]
    out = enclosing.fill_by_enclosing_link(spark.createDataFrame(rows, ROWS), spark.createDataFrame([(1, html)], "page_id long, html string"))
    return [(r["price"], r["fees"]) for r in out.orderBy("pos").collect()]


def test_price_of_the_nearest_block_around_the_link(spark):
    html = "<main><div><span><a href='/ficha/111/?x=1#y'>A</a></span><p>Arriendo $ 900.000, gastos comunes $ 80.000</p></div><div><b>$ 700.000</b><a href='https://homes.example/ficha/222'>B</a></div></main>"
    assert filled(spark, html, "/ficha/111", "/ficha/222/") == [(900_000.0, 80_000.0), (700_000.0, None)]
    assert filled(spark, html, "/ficha/111", "/ficha/222", p1=5.0) == [(900_000.0, 80_000.0), (5.0, None)]


def test_the_climb_ends_at_the_grid_and_at_long_blocks(spark):
    grid = "<div>$ 900.000<p><a href='/ficha/111'>A</a></p><p><a href='/ficha/222'>B</a></p></div>"
    assert filled(spark, grid, "/ficha/111", "/ficha/222") == [(None, None)] * 2
    assert filled(spark, grid, "/ficha/111") == [(900_000.0, None)]  # no other listing of the page is linked there
    assert filled(spark, grid, "/ficha/111", "/ficha/222", p1=1.0)[0] == (None, None)
    long = f"<div>$ 900.000 {'x ' * 300}<p><a href='/ficha/111'>A</a></p></div>"
    assert filled(spark, long, "/ficha/111") == [(None, None)]
    deep = "<div>$ 900.000<i><i><i>{}<a href='/ficha/111'>A</a></i></i></i></div>"
    assert filled(spark, deep.format(""), "/ficha/111") == [(900_000.0, None)]
    assert filled(spark, deep.format("<i>"), "/ficha/111") == [(None, None)]


def test_whole_paths_first_link_and_rows_that_stay(spark):
    html = "<ul><li><a href='/ficha/1112'>x</a> $ 500.000</li><li><a href='/ficha/111'>y</a></li><li><a href='/ficha/111'>z</a> $ 600.000</li></ul>"
    assert filled(spark, html, "/ficha/111", "/ficha/1112") == [(None, None), (500_000.0, None)]
    assert filled(spark, "<p><a href='/f/1'>x</a> $ 500.000</p>", "/f/1", None, BASE, "/nowhere/1") == [(None, None)] * 4
    assert filled(spark, None, "/ficha/111") == [(None, None)]
    assert filled(spark, "<p><a href='/ficha/111'>x</a><script>$ 500.000</script></p>", "/ficha/111", "/ficha/111") == [(None, None)] * 2


def test_rows_beside_one_that_asks_stay_as_they_are(spark):
    rows = [(1, 0, "https://homes.example/ficha/111", BASE, None, None), (1, 1, "https://homes.example/ficha/111/", BASE, 5.0, None), (1, 2, "https://homes.example/ficha/111", "https://homes.example/ficha/111", None, None), (None, 3, "https://homes.example/ficha/111", BASE, None, 7.0), (1, 4, None, BASE, None, None)]
    pages = spark.createDataFrame([(1, "<p>Arriendo $ 900.000, gastos comunes $ 80.000 <a href='/ficha/111'>A</a></p>")], "page_id long, html string")
    out = enclosing.fill_by_enclosing_link(spark.createDataFrame(rows, ROWS), pages)
    assert [tuple(r) for r in out.orderBy("pos").select("pos", "price", "fees").collect()] == [(0, 900_000.0, 80_000.0), (1, 5.0, None), (2, None, None), (3, None, 7.0), (4, None, None)]


def test_no_side_goes_through_the_driver_and_texts_are_read_once(spark):
    rows, pages = spark.createDataFrame([(1, 0, BASE, BASE, None, None)], ROWS), spark.createDataFrame([(1, "")], "page_id long, html string")
    plan = enclosing.fill_by_enclosing_link(rows, pages)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2 and plan.count("ArrowEvalPython") == 1


def test_unclosed_and_crossed_tags():
    (a, b) = enclosing.links_of("<div><p>one <a href='/x/1'>t</a> <img src=q> <b>two</i></div> <p>three <a href='/x/2'>u")
    assert [(x["text"]) for x in a["blocks"]] == ["one t two", "one t two"] and [x["text"] for x in b["blocks"]] == ["three u"]
    assert a["blocks"][1]["opens"] < a["blocks"][0]["opens"] < a["opens"] < a["blocks"][0]["closes"] < a["blocks"][1]["closes"] < b["opens"]
