"""Keys of streets and doors, shown addresses, the ledger of building years, lines of data, rows that say something."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hearthgrid.functions import streets
from hearthgrid.operators import buildings
from hearthgrid.plans import homes
from hearthgrid.sources import lines, listings

TOWNS = ["Vitacura", "Las Condes", "Ñuñoa"]
#: address, place, key, shown
CASES = [
    ("Los Robles Nº 3100", "Ñuñoa", "los robles 3100", "Los Robles Nº 3100"),
    ("Calle Los Robles #3.100", "Ñuñoa", "los robles 3100", "Calle Los Robles #3.100"),
    ("Los Robles Ñuñoa 3100, Ñuñoa, Chile, Metropolitana de Santiago", "Ñuñoa", "los robles 3100 nunoa chile metropolitana de santiago", "Los Robles Ñuñoa 3100, Ñuñoa"),
    ("Los Robles 3100, Región Metropolitana, 7630574", "Ñuñoa", "los robles 3100", "Los Robles 3100"),
    ("Av. Vitacura 5480", "Vitacura", "vitacura 5480", "Av. Vitacura 5480"),
    ("Vitacura 2", "Vitacura", "", ""),
    ("Vitacura, Región Metropolitana", None, "", ""),
    ("comuna de Ñuñoa", "Ñuñoa", "", ""),
    ("Edificio de 180", None, "", ""),
    ("Candelaria Soto, Lo Alto", None, "candelaria soto lo alto", "Candelaria Soto, Lo Alto"),
    ("Las Condes 41 Metropolitana Los Robles 3100 201", "Las Condes", "41 metropolitana los robles 3100 201", "Los Robles 3100 201"),
    ("Avenida Vitacura 312, Metropolitana", "Vitacura", "312 metropolitana", "Avenida Vitacura 312, Metropolitana"),
    ("  ", "Ñuñoa", "", ""),
    (None, None, "", ""),
]


def test_street_keys_and_shown_addresses(spark):
    df = spark.createDataFrame([(i, a, p) for i, (a, p, _, _) in enumerate(CASES)], "i int, a string, p string")
    key, shown = streets.street_key(F.col("a"), F.col("p"), TOWNS), streets.shown_address(F.col("a"), F.col("p"), TOWNS)
    got = df.select("i", key.alias("k"), shown.alias("s"), streets.is_door(key).alias("d")).orderBy("i").collect()
    assert [(r["k"], r["s"]) for r in got] == [c[2:] for c in CASES]
    assert [r["d"] for r in got] == [True, True, False, True, True, *[False] * 9]


def test_map_query(spark):
    df = spark.createDataFrame([(1, "Los Robles 3100, Ñuñoa", "ñuñoa"), (2, "Los Robles 3100,", None), (3, None, "Ñuñoa")], "i int, a string, p string")
    got = df.select("i", streets.map_query(F.col("a"), F.col("p"), "Chile", "Vitacura").alias("q")).orderBy("i").collect()
    assert [r["q"] for r in got] == ["Los Robles 3100, Ñuñoa, Chile", "Los Robles 3100, Vitacura, Chile", "Ñuñoa, Chile"]


_LEDGER = "building string, year int, disputed array<int>, source string, url string, noted date"
_OFFERS = "pos int, building string, built int, age int, source string, url string"


def plain_ledger(ledger, offers, as_of):
    """One listing after the other."""
    known = {r[0]: list(r) for r in ledger}
    for _, b, built, _, source, url in sorted(offers):
        if b is None or built is None or not 1900 <= built <= as_of.year + 3:
            continue
        if b not in known:
            known[b] = [b, built, None, source, url, as_of]
        elif known[b][1] not in (None, built):
            known[b] = [b, None, [known[b][1], built], None, None, as_of]
    return sorted(map(repr, known.values()))


@pytest.mark.parametrize("seed", range(3))
def test_ledger_equals_one_by_one(spark, seed):
    import random

    r, day, as_of = random.Random(seed), dt.date(2026, 1, 1), dt.date(2026, 8, 21)
    ledger = [(f"los robles {k}", None if k % 5 == 0 else 1990 + k % 7, [1990, 1991] if k % 5 == 0 else None, "old", "u", day) for k in range(100, 130)]
    offers = [(i, None if r.random() < 0.1 else f"los robles {r.randrange(100, 150)}", r.choice([None, 1700, 2100, *range(1990, 1994)]), r.choice([None, 3]), r.choice("ab"), f"u{i}") for i in range(120)]
    got = buildings.learn(spark.createDataFrame([*ledger, ("id 44348 las condes", 1999, None, "old", "u", day)], _LEDGER), spark.createDataFrame(offers, _OFFERS), "pos", F.lit(as_of))
    assert sorted(repr(list(x)) for x in got.collect()) == plain_ledger(ledger, offers, as_of)


def test_ledger_answers(spark):
    as_of = F.lit(dt.date(2026, 8, 21))
    offers = spark.createDataFrame([(1, "los robles 3100", None, None, "a", "u1"), (2, "los robles 3100", 2010, None, "b", "u2"), (3, None, None, None, "a", "u3"), (4, "los robles 9", None, 4, "a", "u4"), (5, "los robles 3100", None, 2, "a", "u5")], _OFFERS)
    ledger = buildings.learn(spark.createDataFrame([], _LEDGER), offers, "pos", as_of)
    got = {r["pos"]: (r["built"], r["age"], r["from_ledger"]) for r in buildings.answer(offers, ledger, as_of).collect()}
    assert got == {1: (2010, 16, True), 2: (2010, None, False), 3: (None, None, False), 4: (None, 4, False), 5: (2010, 2, True)}
    none = buildings.answer(offers.limit(0), ledger, as_of)
    assert none.count() == 0 and none.columns == [*offers.columns, "from_ledger"]


def test_data_lines(spark):
    html = "<title>Arriendo</title><style>total{}</style><p>3&nbsp;dormitorios <b>2 baños</b><!-- precio --><p>ARRIENDO<p>uf<p>Vista al parque<script>var precio = 1</script><p>" + "total " * 40 + "<p>Piso\n 4"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>sin nada")], "page_id int, html string")
    got = lines.data_lines(pages, "page_id", "html").orderBy("page_id", "pos").collect()
    assert [(r["page_id"], r["line"]) for r in got] == [(1, "Arriendo"), (1, "3 dormitorios"), (1, "2 baños"), (1, "Piso")]


def test_data_lines_leave_cut_references_alone(spark, duck):
    html = "<h1>1 a &amp; b &amp</h1><p>2 &quot;c&quot; &quot<p>3 &am &a & &#38 &amp;quot; &copy; d<p>4 &middot; &ampe; &copyf; &;<p>5 &amp"
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = lines.data_lines(pages, "page_id", "html", homes._LINE_WORDS).orderBy("pos").collect()
    assert [r["line"] for r in got] == ["1 a & b &amp", '2 "c" &quot', "3 &am &a & &#38 &quot; © d", "4 · &ampe; &copyf; &;", "5 &amp"]
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW pages AS SELECT 1 AS page_id, '{html}' AS html")
    assert sorted(r[1] for r in con.execute(homes.ORACLES["page_data_lines"]).fetchall()) == sorted(r["line"] for r in got)


def test_rows_with_content(spark):
    df = spark.createDataFrame([(1, 0, "", None, "x/simulador"), (2, None, None, None, "x/propiedades/7"), (3, 2, None, None, None), (4, None, "Calle", None, ""), (5, None, None, 0.0, None), (6, None, None, None, None)], "i int, v int, t string, lat double, url string")
    say = lambda pattern: {r["i"] for r in df.where(listings.has_content([F.col("v")], [F.col("t")], [F.col("lat")], F.col("url"), pattern)).collect()}
    assert say(r"/propiedades/\d+") == {2, 3, 4, 5} and say(None) == {3, 4, 5}
