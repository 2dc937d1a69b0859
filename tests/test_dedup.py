"""The five passes against a plain version that walks the listings one by one."""

import math
import os
import random
import re

from hearthgrid.operators import dedup
from hearthgrid.plans import catalog

SF_LARGER = "/root/testdata/sf0.01"

FILL = ["area", "beds", "baths", "address"]
SCHEMA = "ord long, fp string, key string, place string, unit string, source string, title string, text string, address string, price double, area double, lat double, lon double, beds int, baths int, code string, score int, direct boolean"


def known(v):
    return v is not None and v != ""


def richness(a):
    return sum(a[c] not in (None, "", 0) for c in FILL)


def fuse(a, b):
    for c in FILL:
        if not known(a[c]) and known(b[c]):
            a[c] = b[c]
    a["members"] += b["members"]


def collapse(group):
    best = max(group, key=lambda a: (a["score"] or 0, bool(a["direct"]), richness(a)))
    for o in group:
        if o is not best:
            fuse(best, o)
    return best


def grouped(rows, key):
    out = {}
    for a in rows:
        out.setdefault(key(a), []).append(a)
    return list(out.values())


def principal(rows, key, near):
    gone = set()
    for group in grouped([a for a in rows if key(a) is not None], key):
        head = group[0]
        for o in group[1:]:
            if near(head, o) and not any(known(head[c]) and known(o[c]) and abs(head[c] - o[c]) > 1 for c in ("beds", "baths")):
                win = max((head, o), key=lambda a: (a["score"], richness(a)))
                lose = o if win is head else head
                fuse(win, lose)
                gone.add(id(lose))
                head = win
    return [a for a in rows if id(a) not in gone]


def sign(a):
    if re.search(r"\b\d{3,}\b", a["key"]):
        return ""
    if a["price"]:
        return f"clp:{int(a['price'])}"
    return f"prog:{a['beds']}/{a['area']}" if a["beds"] or a["area"] else f"solo:{a['fp'] or a['ord']}"


def plain(rows):
    rows = [dict(r, members=[r["ord"]]) for r in rows]
    rows = [collapse(g) for g in grouped(rows, lambda a: a["fp"] or f"row{a['ord']}")]
    out = [a for a in rows if not (known(a["key"]) and known(a["place"]))]
    for g in grouped([a for a in rows if known(a["key"]) and known(a["place"])], lambda a: (a["key"], a["place"], sign(a))):
        if len({a["unit"] for a in g if known(a["unit"])}) <= 1:
            out.append(collapse(g))
            continue
        units = {}
        for a in g:
            if known(a["unit"]):
                units.setdefault(a["unit"], []).append(a)
        for a in [a for a in g if not known(a["unit"])]:
            fits = [u for u, xs in units.items() if a["price"] is not None and any(x["price"] == a["price"] for x in xs)]
            if len(fits) == 1:
                units[fits[0]].append(a)
            else:
                out.append(a)
        out += [collapse(x) for x in units.values()]
    text = lambda a: f"{a['title'] or ''} {a['text'] or ''}".strip()
    loose = [a for a in out if known(a["address"]) or len(text(a)) < 80]
    rows = loose + [collapse(g) for g in grouped([a for a in out if not (known(a["address"]) or len(text(a)) < 80)], lambda a: (a["source"], text(a)))]

    def km(a, b):
        la, lb = math.radians(a["lat"]), math.radians(b["lat"])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    rows = principal(rows, lambda a: (round(a["price"]), round(a["area"])) if a["lat"] is not None and a["price"] and a["area"] else None, lambda a, b: km(a, b) <= 0.12)
    agree = lambda a, b: (a["area"] and b["area"] and abs(a["area"] - b["area"]) <= 1) or (a["price"] and b["price"] and abs(a["price"] - b["price"]) <= 0.01 * max(a["price"], b["price"]))
    return principal(rows, lambda a: a["code"] or None, agree)


def test_five_passes_equal_the_plain_version(spark):
    rng = random.Random(12)
    pick = lambda *xs: rng.choice(xs)
    rows = []
    for i in range(160):
        long_ = f"un texto de prueba con muchas palabras que no dicen nada en particular numero {rng.randrange(3)} fin"
        rows.append(
            {"ord": i, "fp": pick(None, *[f"f{k}" for k in range(60)]), "key": pick(None, "", "los olmos 100", "los olmos 200", "el roble 300", "las nieves"), "place": pick(None, "macul", "nunoa"), "unit": pick(None, "", "101", "202"), "source": pick("s", "t"), "title": pick(None, "a", long_), "text": pick(None, long_),
             "address": pick(None, "", "x"), "price": pick(None, 500.0, 700.0, 701.0), "area": pick(None, 60.0, 60.4, 80.0), "lat": pick(None, -33.0), "lon": -70.0 + rng.randrange(4) * 0.0005, "beds": pick(None, 1, 2, 3), "baths": pick(None, 1, 2, 4), "code": pick(None, "", "C1", "C2", "C3"), "score": pick(0, 5, 9), "direct": pick(True, False)}
        )
    want = {tuple(sorted(a["members"])): (a["ord"], a["price"], *[a[c] if known(a[c]) else None for c in FILL]) for a in plain(rows)}
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    homes, members = dedup.deduplicate(df.repartition(5), FILL)
    got_rows = {r["ord"]: r for r in homes.collect()}
    classes = {}
    for r in members.collect():
        classes.setdefault(r["into"], []).append(r["ord"])
    got = {tuple(sorted(m)): (k, got_rows[k]["price"], *[got_rows[k][c] for c in FILL]) for k, m in classes.items()}
    assert {m: v[0] for m, v in got.items()} == {m: v[0] for m, v in want.items()}
    assert got == want
    assert all(got_rows[k]["copies"] == len(m) for k, m in classes.items()) and set(classes) == set(got_rows)
    empty = dedup.deduplicate(df.limit(0), FILL)[0]
    assert empty.count() == 0
    for homes_ in (homes, empty):
        folders = [p.removeprefix("file:") for p in homes_.passing.paths]
        assert len(folders) == 2 and all(os.path.isdir(f) for f in folders)
        homes_.passing.release()
        assert not any(os.path.isdir(f) for f in folders)


def compared(listings, homes, members, fill):
    """The classes, their principals and filled fields, against the plain version."""
    want = {tuple(sorted(a["members"])): (a["ord"], a["price"], *[a[c] if known(a[c]) else None for c in fill]) for a in plain(listings)}
    got_rows, classes = {r["ord"]: r for r in homes.collect()}, {}
    for r in members.collect():
        classes.setdefault(r["into"], []).append(r["ord"])
        assert (r["by"] is None) == (r["ord"] == r["into"])
    assert {tuple(sorted(m)): (k, got_rows[k]["price"], *[got_rows[k][c] for c in fill]) for k, m in classes.items()} == want


def test_registered_query_equals_the_plain_version(spark):
    df = catalog.home_listings(spark, SF_LARGER)
    listings = sorted([r.asDict() for r in df.collect()], key=lambda r: r["ord"])
    homes, members = dedup.deduplicate(df, catalog.HOME_FIELDS)
    compared(listings, homes, members, catalog.HOME_FIELDS)
    tags, into = {r["ord"]: f"{r['source']}|{r['url']}" for r in listings}, {r["ord"]: (r["into"], r["by"]) for r in members.collect()}
    assert {by for _, by in into.values()} == {None, *dedup.PASSES}
    elsewhere = {}
    for o, (i, _) in into.items():
        elsewhere.setdefault(i, set()).add(tags[o])
    got = {r["ord"]: r for r in catalog.QUERIES["five_pass_dedup"](spark, SF_LARGER).collect()}
    assert {o: (r["into"], r["by"]) for o, r in got.items()} == into
    assert all(r["elsewhere"] == len(elsewhere[r["into"]] - {tags[r["into"]]}) for r in got.values())


def test_a_street_without_a_number_needs_a_second_sign(spark):
    row = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")]) | {"key": "las nieves", "place": "Vitacura", "source": "s", "score": 0, "direct": True}
    rows = [row | x for x in ({"price": 9.0}, {"price": 9.0, "source": "t"}, {"price": 8.0}, {"beds": 3, "area": 90.0}, {"beds": 3, "area": 90.0}, {"beds": 4, "area": 90.0}, {}, {}, {"key": "las nieves 120"}, {"key": "las nieves 120", "price": 5.0})]
    df = spark.createDataFrame([tuple((r | {"ord": i}).values()) for i, r in enumerate(rows)], SCHEMA)
    df = df.selectExpr("0 + ord as ord", *[c for c in df.columns if c != "ord"], "concat('u', ord) as url")
    _, members = dedup.deduplicate(df, FILL)
    pairs = sorted((r["ord"], r["into"]) for r in members.collect() if r["ord"] != r["into"])
    assert [sorted(p) for p in pairs] == [[0, 1], [3, 4], [8, 9]]
    lost = dict(pairs)
    assert sorted(tuple(r) for r in dedup.also_in(df, members).collect()) == sorted((i, f"{rows[o]['source']}|u{o}") for o, i in lost.items())


def test_codes_are_read_from_the_text_where_there_is_no_column(spark):
    row = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ") if not c.startswith("code")]) | {"score": 0, "direct": True, "area": 80.0}
    rows = [row | {"text": t} for t in ("Cod. 108.143 uno", "otro código: 108143", "cod 108.144", "cod 12")]
    df = spark.createDataFrame([tuple((r | {"ord": i}).values()) for i, r in enumerate(rows)], ", ".join(c for c in SCHEMA.split(", ") if not c.startswith("code")))
    assert {r["ord"]: (r["into"], r["by"]) for r in dedup.deduplicate(df, FILL)[1].collect()} == {0: (0, None), 1: (0, "code"), 2: (2, None), 3: (3, None)}
