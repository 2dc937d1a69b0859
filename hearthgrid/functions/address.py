"""Street addresses and icon rows in running text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ACCENTED, PLAIN, ROAD_WORDS, unaccent

#: Words that may stand inside a street name in lower case, units, and words that mark a flat instead of a door.
CONNECTORS = {"de", "del", "la", "las", "los", "el", "y"}
UNITS = {"m", "m2", "m²", "mts", "mt2", "metros", "uf", "km", "anos", "dias"}
UNIT_MARKS = {"depto", "departamento", "dpto", "unidad", "piso", "torre", "bodega", "oficina", "codigo", "cod", "id"}
_FOLD = str.maketrans(ACCENTED, PLAIN)
_HEIGHT = re.compile(r"[1-9]\d{2,4}")


def find_address(text: str | None, place: str | None) -> str:
    """Street and number: the first free-standing number of three to five digits with a capitalised name before it.

    The name reaches back over at most six capitalised or connecting words, to a kind of road if there's one; the place's name
    at its front is dropped, and at most the last four words stay.
    """
    words = (text or "").split()
    plain = [w.strip(".,;:()").translate(_FOLD).lower() for w in words]
    town = (place or "").translate(_FOLD).lower().split()
    for i, w in enumerate(words):
        number = w.strip(".,;:()")
        if not i or not _HEIGHT.fullmatch(number) or plain[i - 1] in UNIT_MARKS or (i + 1 < len(words) and plain[i + 1] in UNITS):
            continue
        start = i
        for k in range(i - 1, max(-1, i - 7), -1):
            if plain[k] in ROAD_WORDS:
                start = k
                break
            if k < i - 1 and words[k][-1:] in ".,;:":
                break
            if not (words[k][:1].isupper() or plain[k] in CONNECTORS) or plain[k] in UNIT_MARKS:
                break
            start = k
        for k in range(start, i):
            if town and plain[k : k + len(town)] == town and k + len(town) < i:
                start = k + len(town)
        while start < i and plain[start] in CONNECTORS:
            start += 1
        if start < i:
            first = start if plain[start] in ROAD_WORDS else max(start, i - 4)
            return " ".join([*(x.strip(",;:()") for x in words[first:i]), number])
    return ""


def street_address(text: Column, place: Column) -> Column:
    """Address found in a text; empty if there's none. The walk over words needs their order, so it's an Arrow UDF."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, p in batches:
            yield pd.Series([find_address(a, b) for a, b in zip(t, p, strict=True)], dtype=object)

    return run(text, place)


def icon_row(text: Column, order: str) -> dict[str, Column]:
    """Values of the last run of bare one- or two-digit numbers, mapped to the names in ``order`` from its end.

    Null where the run is shorter than the order or a value lies outside 1 to 15.
    """
    names = order.split()
    runs = F.regexp_extract_all(text, F.lit(r"(?:^|(?<=\s))([0-9]{1,2}(?:\s+[0-9]{1,2})*)(?=\s|$)"), F.lit(1))
    last = F.split(F.try_element_at(runs, F.lit(-1)), r"\s+")
    values = F.transform(F.slice(last, -len(names), len(names)), lambda x: x.try_cast("int"))
    usable = (F.size(last) >= len(names)) & F.forall(values, lambda v: v.between(1, 15))
    return {n: F.when(usable, F.get(values, F.lit(i))) for i, n in enumerate(names)}


def query_variants(address: Column, suffix: str) -> Column:
    """Up to four ordered, distinct search texts: whole, without the kind of road, without the number, without both."""
    road = rf"(?i)^({'|'.join(ROAD_WORDS)})\.?\s+"
    bare, short = F.regexp_replace(unaccent(address), road, ""), F.regexp_replace(unaccent(address), r"\s+[0-9]+\s*$", "")
    all_ = F.array(unaccent(address), bare, short, F.regexp_replace(short, road, ""))
    good = F.filter(F.transform(all_, lambda x: F.trim(x)), lambda x: (F.length(x) >= 3) & x.rlike("[A-Za-z]"))
    return F.transform(F.array_distinct(good), lambda x: F.concat(x, F.lit(f", {suffix}")))
