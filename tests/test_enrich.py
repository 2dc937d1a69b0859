"""Detail pages: which readings are the listing's own, what is taken from them, and the text from its anchor on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthgrid.operators.enrich import Reading, enrich
from hearthgrid.sources import detail, listings

FIELDS = ("age", "built", "fees", "total", "floor", "bedrooms", "baths", "place", "address")
KINDS = "age int, built int, fees double, total double, floor int, bedrooms int, baths int, place string, address string"
LISTING = f"id int, url string, direct boolean, title string, lat double, lon double, price double, price_uf double, {KINDS}"
CANDIDATE = f"page_url string, url string, pos int, price double, price_uf double, {KINDS}"
TEXT = f"page_url string, anchored boolean, price double, price_uf double, {KINDS}"
READ = Reading(FIELDS)
PAGE = "https://homes.example/aviso/5"


def frame(spark, kinds, rows):
    names = [c.split()[0] for c in kinds.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], kinds)


def run(spark, listing, candidates=(), text=None, pin=None):
    rows = [{"id": 1, "url": PAGE, "direct": True} | listing]
    texts = [] if text is None else [{"page_url": PAGE, "anchored": False} | text]
    pins = [] if pin is None else [{"page_url": PAGE, "lat": pin[0], "lon": pin[1]}]
    out = enrich(frame(spark, LISTING, rows), frame(spark, CANDIDATE, [{"page_url": PAGE, "pos": i} | c for i, c in enumerate(candidates)]), frame(spark, TEXT, texts), frame(spark, "page_url string, lat double, lon double", pins), READ)
    (got,) = out.collect()
    return got


def test_only_what_leads_to_the_listing_is_taken(spark):
    neighbours = [{"url": "/aviso/101", "bedrooms": 4, "baths": 5}, {"url": "/aviso/102", "bedrooms": 3}]
    got = run(spark, {"price": 1_500_000.0}, neighbours)
    assert (got["bedrooms"], got["baths"], got["enriched"], got["origin"]) == (None, None, False, {})
    own = {"url": "http://WWW.homes.example/aviso/5/?utm=x#photos", "bedrooms": 3, "baths": 2, "price": 9.0}
    got = run(spark, {"price": 1_500_000.0}, [*neighbours, own, own | {"baths": 7, "total": 90.0}])
    assert (got["bedrooms"], got["baths"], got["total"], got["price"], got["enriched"]) == (3, 2, 90.0, 1_500_000.0, True)
    assert got["origin"] == {"bedrooms": "own", "baths": "own", "total": "own"}


@pytest.mark.parametrize(("candidate", "taken"), [({}, True), ({"place": "VITACURÁ"}, True), ({"place": "otra"}, False), ({"bedrooms": 2}, False), ({"baths": 1}, True)])
def test_a_lone_candidate_must_not_contradict(spark, candidate, taken):
    got = run(spark, {"place": "Vitacura", "bedrooms": 3}, [{"url": None, "built": 2018} | candidate])
    assert (got["built"], got["enriched"]) == ((2018, True) if taken else (None, False))


def test_a_contradicting_text_loses_only_those_fields_where_the_page_is_the_listings(spark):
    said = {"bedrooms": 3, "baths": 2, "built": 1978, "age": 48, "fees": 430_000.0}
    got = run(spark, {"bedrooms": 4}, text=said | {"anchored": True})
    assert (got["bedrooms"], got["baths"], got["built"], got["fees"]) == (4, 2, 1978, 430_000.0)
    assert got["origin"] == {"baths": "text", "built": "text", "age": "text", "fees": "text"}
    assert run(spark, {"bedrooms": 4}, [{"url": PAGE}], said)["built"] == 1978
    got = run(spark, {"bedrooms": 4}, text=said)
    assert (got["built"], got["enriched"]) == (None, False)


def test_an_unanchored_text_gives_the_year_alone(spark):
    said = {"bedrooms": 3, "total": 250.0, "price": 9_000_000.0, "built": 1978, "age": 48}
    got = run(spark, {}, text=said)
    assert (got["age"], got["built"], got["bedrooms"], got["total"], got["price"], got["enriched"]) == (48, 1978, None, None, None, True)
    assert run(spark, {}, text={"bedrooms": 3})["enriched"] is False


def test_the_text_of_a_list_page_is_nobodys(spark):
    got = run(spark, {}, [{"url": f"/aviso/{i}"} for i in range(5)], {"anchored": True, "built": 2000})
    assert (got["built"], got["enriched"]) == (None, False)
    assert run(spark, {}, [{"url": f"/aviso/{i}"} for i in range(4)], {"anchored": True, "built": 2000})["built"] == 2000


def test_a_price_comes_whole_and_only_where_there_is_none(spark):
    own = [{"url": PAGE}, {"url": PAGE, "price_uf": 46.5}, {"url": PAGE, "price": 1.0, "price_uf": 2.0}]
    got = run(spark, {}, own, {"anchored": True, "price": 5.0})
    assert (got["price"], got["price_uf"], got["origin"]) == (None, 46.5, {"price_uf": "own"})
    got = run(spark, {}, own[:1], {"anchored": True, "price": 5.0})
    assert (got["price"], got["origin"]) == (5.0, {"price": "text"})
    assert run(spark, {"price_uf": 40.0}, own)["price"] is None


def test_pin_first_and_listings_that_stay(spark):
    got = run(spark, {}, [{"url": PAGE, "built": 2000}], pin=(-33.4, -70.6))
    assert (got["lat"], got["lon"], got["origin"]) == (-33.4, -70.6, {"lat": "pin", "lon": "pin", "built": "own"})
    assert run(spark, {"lat": 1.0, "lon": 2.0}, pin=(-33.4, -70.6))["lat"] == 1.0
    for still in ({"direct": False}, {"url": None}, {"url": " "}, {"url": "https://homes.example/other"}, {"direct": None}):
        got = run(spark, still, [{"url": PAGE, "built": 2000}], {"built": 1990}, (-33.4, -70.6))
        assert (got["built"], got["lat"], got["enriched"], got["origin"]) == (None, None, False, {})
    full = {"age": 1, "fees": 1.0, "total": 1.0, "floor": 1, "bedrooms": 1, "baths": 1, "lat": 1.0, "address": "a", "price": 1.0}
    assert run(spark, full, [{"url": PAGE, "built": 2000}])["built"] is None
    assert run(spark, full | {"address": " "}, [{"url": PAGE, "built": 2000}])["built"] == 2000


def text_of(spark, html, title=None, address=None):
    pages = spark.createDataFrame([(PAGE, html)], "page_url string, html string")
    own = spark.createDataFrame([(PAGE + "?x=1", title, address)], "url string, title string, address string")
    return detail.text_readings(pages, own, F.lit(dt.date(2026, 8, 21))).collect()


def test_the_header_before_the_title_wins_over_prose(spark):
    html = """<html><script>3 dormitorios</script><body><div>Precio convertido: $1.817.308 · 4 habitaciones 5 baños · Piso 5 · Año de construcción: 2010</div>
    <h1>Amplio departamento en calle  tranquila</h1><p>Primer piso: living, 3 dormitorios y 2 baños. Gastos comunes $ 250.000. Superficie 142 m2 totales</p></body></html>"""
    (got,) = text_of(spark, html, title="amplio DEPARTAMENTO en calle tranquila")
    assert got["anchored"] and (got["bedrooms"], got["baths"], got["floor"], got["built"], got["price"], got["total"], got["fees"]) == (4, 5, 5, 2010, 1_817_308.0, 142.0, 250_000.0)
    (got,) = text_of(spark, html, title="another title that isn't there", address="none of it, either")
    assert not got["anchored"] and got["bedrooms"] in (3, 4)


def test_text_is_cut_at_the_address_and_needs_a_long_enough_anchor(spark):
    html = "<body>Sugerencias de la semana: 6 dormitorios y 7 baños aqui <b>Av. Los Leones 1234</b>, 2 dormitorios, monto suelto $ 900.000</body>"
    (got,) = text_of(spark, html, title="Depto", address="Av. Los Leones 1234, Providencia")
    assert got["anchored"] and got["price"] is None
    assert not text_of(spark, html, title="Depto", address="Leones 12")[0]["anchored"]
    assert text_of(spark, "<p>corto</p>", title="x" * 40) == [] and text_of(spark, None) == []


def test_pages_are_dealt_out_and_each_is_read_once(spark):
    pages = spark.createDataFrame([("https://a.example/1", "<p>x")], "page_url string, html string")
    own = spark.createDataFrame([("https://a.example/1", "t", "a")], "url string, title string, address string")
    plan = detail.text_readings(pages, own, F.lit(dt.date(2026, 8, 21)))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "REPARTITION_BY_NUM" in plan
    assert plan.count("ArrowEvalPython") == 3 and plan.count("translate(") == 2  # the page, its header and its body


def test_pages_to_listings_in_one_go(spark):
    html = """<body><script type="application/ld+json">[{"@type":"Place","name":"Región"},{"@type":"ApartmentComplex","url":"/aviso/5","name":"Depto","numberOfBedrooms":3,
    "potentialAction":[{"priceSpecification":{"price":"47","priceCurrency":"clf"}}]},{"@type":"apartment","url":"/aviso/9","name":"Otro","numberOfBedrooms":6,"offers":{"price":1}}]</script>
    <iframe src="https://maps.example/embed?q=-33.40,-70.57"></iframe><h1>Departamento con terraza grande</h1> Año de construcción 2011, gastos comunes $ 90.000, 2 baños</body>"""
    pages = spark.createDataFrame([(1, PAGE, html)], "page_id long, page_url string, html string")
    own = frame(spark, LISTING, [{"id": 1, "url": PAGE, "direct": True, "title": "Departamento con terraza grande"}])
    rows = listings.assemble(listings.extract(pages, url_col="page_url"))
    assert rows.count() == 2
    candidates = rows.join(pages.select("page_id", "page_url"), "page_id").select(
        "page_url", "url", "pos", F.when(F.col("currency") != "CLF", F.col("price")).alias("price"), F.when(F.col("currency") == "CLF", F.col("price")).alias("price_uf"),
        F.lit(None).cast("int").alias("age"), "built", "fees", "total", F.lit(None).cast("int").alias("floor"), "bedrooms", "baths", "place", "address",
    )
    said = detail.text_readings(pages, own, F.lit(dt.date(2026, 8, 21))).withColumns({"price_uf": F.lit(None).cast("double"), "place": F.lit(None).cast("string"), "address": F.lit(None).cast("string")})
    (got,) = enrich(own, candidates, said, detail.page_pins(pages), READ).collect()
    assert (got["bedrooms"], got["baths"], got["price_uf"], got["built"], got["fees"], got["lat"]) == (3, 2, 47.0, 2011, 90_000.0, -33.40)
    assert got["origin"] == {"bedrooms": "own", "baths": "text", "price_uf": "own", "built": "text", "age": "text", "fees": "text", "lat": "pin", "lon": "pin"}
