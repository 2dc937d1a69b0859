"""Golden cases of the parsers."""

import datetime
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import amounts, text
from hearthgrid.functions.geo import haversine_km

AS_OF = datetime.date(2026, 8, 16)


def value(spark, column, raw, kind="string"):
    return spark.createDataFrame([(raw,)], f"t {kind}").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2.340.000", 2340000), ("2340000", 2340000), ("2.340,75", 2340.75), ("3,7", 3.7), ("91", 91), ("4,210,000", 4210000), ("4,210,000.5", 4210000.5), ("2 340 000", 2340000), (",5", 0.5), (".,5", 0.5),
        ("1.2345", 1.2345), ("1234.567", 1234567), ("12.34,5", 1234.5), ("1.5", 1.5), ("", None), ("abc", None), ("1.2.3", None), ("2,340", 2.34), ("1,2,3", None), ("5,", None), (".567", None), ("-3", None), (None, None),
    ],
)
def test_locale_number(spark, raw, want):
    assert value(spark, text.locale_number, raw) == want


@pytest.mark.parametrize(
    ("raw", "rent", "fees"),
    [
        ("Renta: $880.000. Gastos comunes: $95.000.", 880000, 95000),
        ("Canon $720.000 + G.C. $60.000", 720000, 60000),
        ("$1.310.000 mensuales, $140.000 de gastos comunes", 1310000, 140000),
        ("Piso 2D 1B · $640.000 · $70.000", 640000, 70000),
        ("Gastos comunes cerca de $85.000. Arriendo por mes $910.000.", 910000, 85000),
        (None, None, None),
        ("", None, None),
    ],
)
def test_rent_and_fees(spark, raw, rent, fees):
    (got,) = money_of(spark, [raw])
    assert (got["rent"], got["fees"]) == (rent, fees)


def money_of(spark, raws, rate=40_000.0):
    df = spark.createDataFrame(list(enumerate(raws)), "i int, t string").select("i", amounts.read_amounts(F.col("t")).alias("a"))
    out = df.select("i", *[v.alias(k) for k, v in amounts.money(F.col("a"), rate).items()], *[v.alias(f"labelled_{k}") for k, v in amounts.labelled_money(F.col("a"), rate).items()])
    return [r for _, r in sorted((r["i"], r) for r in out.collect())]


MONEY = (
    [
        ("Canon 1,4 millones al mes", {"rent": 1_400_000}),
        ("se arrienda por 980.000 pesos", {"rent": 980_000}),
        ("Piso por CLP 1600000.00", {"rent": 1_600_000, "labelled_rent": None}),
        ("Disponible 720.000", {"rent": 720_000, "labelled_rent": None}),
        ("subirá 300.000. (luego $400.000)", {"rent": 400_000, "fees": None}),
        ("Valor $1.450.000 + G.C. $180.000", {"rent": 1_450_000, "fees": 180_000, "labelled_rent": None, "labelled_fees": 180_000}),
        ("Arriendo: $1.100.000 más gastos comunes de $150.000", {"rent": 1_100_000, "fees": 150_000}),
        ("GGCC $500.000", {"rent": None, "fees": 500_000}),
        ("Gastos comunes aprox. $220.000", {"rent": None, "fees": 220_000}),
        ("$220.000 de gastos comunes", {"rent": None, "fees": 220_000}),
        ("*Gastos comunes: $400.000 en verano y $490.000 en invierno", {"rent": None, "fees": 400_000}),
        ("gastos comunes $250.000-$300.000", {"rent": None, "fees": 250_000}),
        ("Arriendo $1.500.000 - GC $200.000", {"rent": 1_500_000, "fees": 200_000}),
        ("$1.550.000 / $220.000", {"rent": 1_550_000, "fees": 220_000}),
        ("$1.550.000 / $220.000 / $210.000", {"rent": 1_550_000, "fees": None}),
        ("Valor promedio de arriendo $350.000", {"rent": None, "fees": None}),
        ("promedio del sector $2.400.000 Precio convertido: $1.817.308", {"rent": 1_817_308, "labelled_rent": 1_817_308}),
        ("gastos comunes promedio $180.000", {"fees": 180_000}),
        ("Garantía $900.000, comisión $450.000, contribuciones $300.000", {"rent": None, "fees": None}),
        ("Arriendo $900.000, garantía 2 meses", {"rent": 900_000, "guarantee": 2}),
        ("garantía equivalente a un mes", {"guarantee": 1}),
        ("3 meses de garantía", {"guarantee": 3}),
        ("Precio de venta $95.000.000", {"rent": None, "sale": 95_000_000}),
        ("$120.000.000", {"rent": None, "sale": 120_000_000}),
        ("Arriendo en $36.000.000", {"rent": None, "sale": None}),
        ("Cod. 409.892 bonito", {"rent": None}),
        ("AT397.842* local", {"rent": None}),
        ("*MPB*411.605. Luego", {"rent": None}),
        ("por 850.000 nada más", {"rent": 850_000}),
        ("UF 42,5 mensuales", {"rent": 1_700_000, "rent_uf": 42.5}),
        ("CLF 46.00", {"rent": 1_840_000, "rent_uf": 46}),
        ("30 u.f.", {"rent": 1_200_000, "rent_uf": 30}),
        ("Valor UF hoy 39,5 UF según el banco central del país; canon 50 UF", {"rent_uf": 50}),
        ("UF 39.500 del día, UF 4", {"rent_uf": None, "rent": None}),
        ("Arriendo $900.000 o UF 23", {"rent": 900_000, "rent_uf": None}),
        ("Gastos comunes: UF 15,15", {"fees": 606_000}),
        ("Gastos comunes: UF 1.500", {"fees": None}),
        ("Gastos comunes $90.000 (UF 2,2)", {"fees": 90_000}),
        ("arriendo $ 5.000, $ 300.000", {"rent": 300_000}),
        ("", {"rent": None, "fees": None, "sale": None, "guarantee": None}),
        (None, {"rent": None, "rent_uf": None, "fees": None, "guarantee": None}),
    ]
)


def test_money(spark):
    got = money_of(spark, [raw for raw, _ in MONEY])
    assert [(raw, {k: r[k] for k in want}) for (raw, want), r in zip(MONEY, got, strict=True)] == MONEY


def test_numbers_in_python_equal_those_of_the_column(spark):
    raws = ["2.340.000", "2340000", "2.340,75", "3,7", "4,210,000", "4,210,000.5", "2 340 000", "1.2345", "12.34,5", "1.5", "", "abc", "1.2.3", "2,340", "1,2,3", "5,", ".567", "-3"]
    got = spark.createDataFrame([(r,) for r in raws], "t string").select("t", text.locale_number(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == {r: amounts.number_of(r) for r in raws}


@pytest.mark.parametrize(
    ("raw", "total", "useful", "terrace"),
    [
        ("Superficie útil 72 m² y superficie total 85 m²", 85, 72, None),
        ("72 m² útiles y 9 m² de terraza", 81, 72, 9),
        ("Piso de 85 m² / 72 m²", 85, 72, None),
        ("Piso de 72 m² en el centro", None, 72, None),
        ("Superficie total 85,5 m²", 85.5, None, None),
        ("Superficie mt2 72", None, 72, None),
    ],
)
def test_areas(spark, raw, total, useful, terrace):
    got = spark.createDataFrame([(raw,)], "t string").select(*[c.alias(k) for k, c in text.areas(F.col("t")).items()]).first()
    assert (got["total"], got["useful"], got["terrace"]) == (total, useful, terrace)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("3 dormitorios, 2 baños", (3, 2, None)), ("Depto 3D/2B", (3, 2, None)), ("tres dormitorios y dos baños", (3, 2, None)), ("con estacionamiento y bodega", (None, None, 1))],
)
def test_programme(spark, raw, want):
    p = text.programme(F.col("t"))
    assert tuple(spark.createDataFrame([(raw,)], "t string").select(p["bedrooms"], p["baths"], p["parking"]).first()) == want


@pytest.mark.parametrize(("raw", "want"), [("Año de construcción: 2018", (2018, 8, None)), ("Antigüedad: 12 años", (2014, 12, None)), ("a estrenar", (None, None, 2)), ("Edificio nuevo en venta", (None, None, 5))])
def test_building_age(spark, raw, want):
    a = text.building_age(F.col("t"), F.lit(AS_OF))
    assert tuple(spark.createDataFrame([(raw,)], "t string").select(a["built"], a["age"], a["age_ceiling"]).first()) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("12 de julio 2026", datetime.date(2026, 7, 12)), ("publicado 05/07/26", datetime.date(2026, 7, 5)), ("hace 3 días", datetime.date(2026, 8, 13)), ("hace 2 semanas", datetime.date(2026, 8, 2)), ("hace 5 horas", AS_OF), ("hace 900 días", None), ("ayer", None)],
)
def test_spoken_date(spark, raw, want):
    assert value(spark, lambda c: text.spoken_date(c, F.lit(AS_OF)), raw) == want


def test_floor_and_unit(spark):
    f = text.floor_and_unit(F.col("t"))
    df = spark.createDataFrame([("Depto 802 en piso 8",), ("Departamento 1102",), ("piso 99",), (None,)], "t string")
    assert [tuple(r) for r in df.select(f["floor"], f["unit"]).collect()] == [(8, "802"), (11, "1102"), (None, None), (None, None)]


def test_five_spellings_are_one_identity(spark):
    spellings = ["Los Álamos 3150", "LOS ALAMOS 3.150", "Av. Los Álamos N° 3150", "Los Alamos 3150, Ñuñoa", "Avenida Los Álamos nro 3150 Ñuñoa"]
    df = spark.createDataFrame([(s, "Ñuñoa", f"https://a/{i}") for i, s in enumerate(spellings)], "a string, p string, u string")
    key = text.address_key(F.col("a"), F.col("p"))
    assert df.select(text.fingerprint(key, F.col("p"), F.lit(None).cast("string"), F.col("u"), F.lit("t")).alias("f")).distinct().count() == 1


def test_identity_without_a_door_is_the_url_and_the_own_text(spark):
    rows = [("Los Álamos", "https://a/aviso?id=1", "x"), ("Los Álamos", "https://a/aviso?id=2", "x"), ("Los Álamos", "https://a/aviso?id=2", "y"), (None, "https://a/aviso?id=2", "Y")]
    df = spark.createDataFrame(rows, "a string, u string, d string")
    fp = text.fingerprint(text.address_key(F.col("a"), F.lit("Ñuñoa")), F.lit("Ñuñoa"), F.lit(None).cast("string"), F.col("u"), F.col("d"))
    got = [r[0] for r in df.select(fp).collect()]
    assert got[0] != got[1] != got[2] and got[2] == got[3]
    assert got[0] == hashlib.sha1(b"https://a/aviso?id=1|x").hexdigest()[:16]


def test_human_code(spark):
    letters, n, want = "23456789ABCDEFGHJKMNPQRSTUVWXYZ", int("fedcba987654", 16), ""
    for _ in range(5):
        want, n = want + letters[n % 31], n // 31
    assert text.CODE_ALPHABET == letters and value(spark, text.human_code, "fedcba9876543210") == want


def test_pin_distance_and_codes(spark):
    pin = value(spark, text.map_pin, '<a href="https://maps?q=10.5,20.5"><a href="https://maps/!2d-70.56!3d-33.38">')
    assert (pin["lat"], pin["lon"]) == (-33.38, -70.56)
    km = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), 0.0, 1.0).alias("k")).first()["k"]
    assert abs(km - 111.195) < 0.01
    assert len(value(spark, text.human_code, "0123456789abcdef")) == 5


def test_longest_name(spark):
    names = ["of", "a.b", "the", "and", "with", "mente", "ñu", "-x"]
    cases = [("of the", "the"), ("and the", "and"), ("withal lentamente of", "of"), ("lentamente mente", "mente"), ("theand", None), ("éthe", "the"), ("the\n", "the"), ("_with_", "with"), ("a.b", "a.b"), ("axb of", "of"), ("ñu", "ñu"), ("xñu9", None), ("a-x -x", "-x"), ("othe the9", None), ("", None), (None, None)]
    got = spark.createDataFrame(list(enumerate(c[0] for c in cases)), "i int, t string").select("i", text.longest_name(F.col("t"), names).alias("v"))
    assert [r["v"] for r in got.orderBy("i").collect()] == [c[1] for c in cases]


def test_longest_name_looks_for_the_names_characters(spark):
    names = ["the", "this", "that", "with", "and", "was", "of", "from", "are", "mente", "nicht", "pour"]
    long = spark.range(1).select(F.repeat(F.concat(F.lit("wort "), F.col("id").cast("string")), 5_000_000).alias("t"))  # 35M characters
    began = time.perf_counter()
    assert long.select(text.longest_name(F.col("t"), names).alias("v")).first()["v"] is None
    assert time.perf_counter() - began < 8
