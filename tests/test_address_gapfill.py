"""Addresses, icon rows and page-level gap filling."""

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import address
from hearthgrid.operators import gapfill


@pytest.mark.parametrize(
    ("text", "place", "want"),
    [
        ("Parque Los Olmos Avenida Los Olmos 5120", None, "Avenida Los Olmos 5120"),
        ("Departamento de 88 m² en Tomas Moro 1430", None, "Tomas Moro 1430"),
        ("Arriendo en San Miguel Isabel Riquelme 2750", "San Miguel", "Isabel Riquelme 2750"),
        ("Depto 802", None, ""),
        ("sin número en la calle", None, ""),
        (None, None, ""),
    ],
)
def test_find_address(text, place, want):
    assert address.find_address(text, place) == want


def test_address_columns(spark):
    df = spark.createDataFrame([("Hermoso en $1.250.000 2 1 2", "Tomas Moro 1430"), ("publicado 75 m 2 2 1 2", "Av. Las Condes 99"), ("hace 3", None)], "t string, a string")
    i = address.icon_row(F.col("t"), "d e b")
    out = df.select(i["d"].alias("d"), i["e"].alias("e"), i["b"].alias("b"), address.street_address(F.col("a"), F.lit(None).cast("string")).alias("s"), address.query_variants(F.col("a"), "Chile").alias("v")).collect()
    assert [tuple(r)[:4] for r in out] == [(2, 1, 2, "Tomas Moro 1430"), (2, 1, 2, ""), (None, None, None, "")]
    assert out[0]["v"] == ["Tomas Moro 1430, Chile", "Tomas Moro, Chile"] and out[1]["v"][1] == "Las Condes 99, Chile" and out[2]["v"] == []


def test_gap_fills(spark):
    rows = spark.createDataFrame([(1, i, f"u{i}", f"title {i} long", b, None) for i, b in enumerate((2, 3, None, 4))] + [(2, 0, "v", "x", 1, 9.0)], "page int, pos int, url string, title string, beds int, price double")
    cards = spark.createDataFrame([(1, i, f"u{i % 3}", f"card title {i} long", b, 10.0 + i) for i, b in enumerate((2, 3, 5, 4))], "page int, pos int, url string, text string, beds int, price double")
    by_key = {r["url"]: r["price"] for r in gapfill.fill_by_key(rows, cards, ["url"], ["price"]).collect()}
    assert by_key == {"u0": None, "u1": 11.0, "u2": 12.0, "u3": None, "v": 9.0}
    by_title = {r["url"]: r["price"] for r in gapfill.fill_by_title(rows, cards, "page", "pos", "title", "text", ["price"]).collect()}
    assert by_title == {"u0": 10.0, "u1": 11.0, "u2": 12.0, "u3": 13.0, "v": 9.0}
    by_pos = {(r["page"], r["pos"]): (r["price"], r["beds"]) for r in gapfill.fill_by_position(rows, cards, "page", "pos", ["beds"], ["price", "beds"]).collect()}
    assert by_pos == {(1, 0): (10.0, 2), (1, 1): (11.0, 3), (1, 2): (12.0, 5), (1, 3): (13.0, 4), (2, 0): (9.0, 1)}
    clash = cards.withColumn("beds", F.when(F.col("pos") == 1, 9).otherwise(F.col("beds")))
    assert {r["price"] for r in gapfill.fill_by_position(rows, clash, "page", "pos", ["beds"], ["price"]).collect()} == {None, 9.0}
