"""What an address identifies: the key of a street or door, the address as it's shown, and the query for a map.

Names of towns are arguments. All expressions stay in the JVM; ``_let`` names a value that is used more than once, so that
nested steps don't repeat the ones before them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import key_text

#: Kinds of road at the front of an address.
ROAD_KINDS = "avenida avda avd av pasaje psje pje callejon calle camino".split()
#: Marks of a house number, and words from which on an address names only an administration.
DOOR_MARKS, OFFICE_WORDS = "n nº n° no nro num numero".split(), "comuna region provincia ciudad".split()
#: Words that connect the parts of a name.
CONNECTING = "de del la las el los y en".split()
#: Words that aren't the name of a street by themselves.
NOT_A_NAME = """
metropolitana region regiones rm provincia santiago chile chl cl comuna bedrooms bathrooms rooms beds baths dormitorios dormitorio
banos bano habitaciones habitacion piezas pieza m2 mts mt sqm parking parks estacionamientos estacionamiento bodega bodegas piso pisos
depto departamento apartamento casa uf clp precio
""".split()
#: Words that stand in no street's name, so an address that holds one is none.
NEVER = """
edificio edificios departamento departamentos depto deptos duplex penthouse loft consta cuenta dispone incluye gas horno cocina living
comedor terraza terrazas logia quincho quinchos cava bodega bodegas conserjeria estacionamiento estacionamientos ascensor ascensores
piscina gimnasio sauna dormitorio dormitorios pieza piezas habitacion habitaciones bano banos bedrooms bathrooms antiguedad superficie
terreno util utiles metros mts m2 uf clp arriendo arriendos venta ventas precio canon id cod codigo rol pocos poco solo unicamente
partir pasos apenas quedan amoblado amoblada remodelado remodelada impecable espectacular hermoso hermosa luminoso luminosa exclusivo
exclusiva moderno moderna amplio amplia acogedor acogedora mapa realty propiedad propiedades inmobiliaria corredora broker comercial
vistas despejado despejada despejados despejadas
""".split()

_HEIGHT = "(^|[^0-9])[0-9]{3,}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def _keys(towns: Sequence[str]) -> list[str]:
    from .text import folded

    return [folded(t) for t in towns]


def _without_town(key: Column, town: Column) -> Column:
    """Leaves out the town at the end if a digit stays, and before a digit if something that can be a name stays."""
    bounded = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), town, F.lit(r" +(?=[0-9])"))
    end = lambda k: F.when(F.endswith(k, F.concat(F.lit(" "), town)), F.rtrim(F.left(k, F.length(k) - F.length(town) - 1)))
    named = lambda k: F.exists(F.split(k, " +"), lambda w: (w != "") & ~w.isin(ROAD_KINDS) & ~w.rlike("^[0-9]+$"))
    shorter = _let(end(key), lambda e: F.when(e.rlike("[0-9]"), e).otherwise(key))
    return _let(shorter, lambda k: _let(F.regexp_replace(k, bounded, F.lit("")), lambda m: F.when(named(m), m).otherwise(k)))


def _identifying(key: Column, town: Column, towns: Sequence[str]) -> Column:
    words = F.split(key, " +")
    passed = F.array_union(F.array_union(_words([*NOT_A_NAME, *CONNECTING]), F.split(town, " +")), _words([w for t in _keys(towns) for w in t.split()]))
    name = F.exists(words, lambda w: ~F.array_contains(passed, w) & ~w.rlike("^[0-9]+$"))
    height = key.rlike(_HEIGHT)
    return F.when((name | height) & ~F.arrays_overlap(words, _words(NEVER)) & (height | ~key.rlike("[0-9]")), key).otherwise("")


def street_key(address: Column, place: Column, towns: Sequence[str] = ()) -> Column:
    """Key under which spellings of one street or door meet, or an empty text if the address identifies no place.

    A street without a number has a key; a number below three digits is no door. Administrative tails, number marks, the kind of
    road and the place's own name are left out, the latter only where a name stays. A null place is none.
    """
    marks = rf"(?<![\p{{L}}\p{{N}}_])({'|'.join(sorted(DOOR_MARKS, key=len, reverse=True))}) *(?=[0-9])"
    tail = rf"(^| )({'|'.join(OFFICE_WORDS)})( .*)?$"
    plain = F.regexp_replace(key_text(address), marks, "")
    cut = _let(plain, lambda p: _let(F.trim(F.regexp_replace(p, tail, "")), lambda c: F.when(c != "", c).otherwise(p)))
    led = F.regexp_replace(cut, rf"^({'|'.join(ROAD_KINDS)})( +|$)", "")
    town = key_text(F.coalesce(place, F.lit("")))
    bare = lambda k, t: F.when(t == "", k).when(k == t, "").otherwise(_without_town(k, t))
    tidy = lambda k: F.trim(F.regexp_replace(k, " +", " "))
    return _let(town, lambda t: _let(_let(led, lambda k: tidy(bare(k, t))), lambda k: F.when(k == "", "").otherwise(_identifying(k, t, towns))))


def is_door(key: Column) -> Column:
    """The key holds a free-standing number of three digits or more and no word that tells an older, worse key."""
    words = F.split(key, " +")
    return F.coalesce(F.exists(words, lambda w: w.rlike("^[0-9]{3,}$")) & ~F.arrays_overlap(words, _words([*NEVER, *NOT_A_NAME])), F.lit(False))


def door_key(address: Column, place: Column, towns: Sequence[str] = ()) -> Column:
    """The key of a building, or null: a street without a number is none."""
    key = street_key(address, place, towns)
    return _let(key, lambda k: F.when(F.exists(F.split(k, " +"), lambda w: w.rlike("^[0-9]{3,}$")), k))


def without_office_head(address: Column, towns: Sequence[str], regions: Sequence[str] = ("metropolitana", "de santiago")) -> Column:
    """Leaves out a front of town, internal number and region; a front that opens with no known town is a street and stays."""
    named = "|".join(r.replace(" ", r"\s+") for r in regions)
    head = rf"(?iU)^[\w\s]{{3,24}}?\s+[0-9]{{1,5}}\s+(regi[oó]n\s+(de\s+)?)?({named})\b[\s,.\-]*"
    opens = lambda h: F.exists(_words(_keys(towns)), lambda t: F.startswith(F.concat(key_text(h), F.lit(" ")), F.concat(t, F.lit(" "))))
    d = F.trim(F.coalesce(address, F.lit("")))
    return _let(d, lambda a: _let(F.regexp_extract(a, head, 0), lambda h: F.when((h != "") & opens(h), F.btrim(F.substr(a, F.length(h) + 1), F.lit(" ,.-"))).otherwise(a)))


def shown_address(address: Column, place: Column, towns: Sequence[str] = ()) -> Column:
    """The address as it's shown, or an empty text if it identifies no place.

    It ends before the first part, after a comma, that opens with an administrative word, or behind the first that is a known
    town; if what is left identifies nothing, it stays whole.
    """
    office = rf"^({'|'.join(OFFICE_WORDS)})( |$)"
    town = lambda k: F.array_contains(_words(_keys(towns)), k)
    stop = lambda p, i: _let(key_text(p), lambda k: F.when((i >= 1) & k.rlike(office), i).when((i >= 1) & town(k), i + 1))

    def cropped(d: Column) -> Column:
        parts = F.transform(F.split(d, ","), lambda p: F.trim(p))
        return _let(parts, lambda ps: F.array_join(F.slice(ps, F.lit(1), F.coalesce(F.get(F.filter(F.transform(ps, stop), lambda s: s.isNotNull()), F.lit(0)), F.size(ps))), ", "))

    whole = lambda d: F.when(street_key(d, place, towns) != "", _let(cropped(d), lambda c: F.when((c != "") & (street_key(c, place, towns) != ""), c).otherwise(d))).otherwise("")
    return _let(without_office_head(address, towns), whole)


def map_query(address: Column, place: Column, country: str, home: str) -> Column:
    """Search text for a map: the address, its place (``home`` where unknown) unless the address ends in it, and the country."""
    d = F.rtrim(F.trim(F.coalesce(address, F.lit("")))), F.coalesce(F.nullif(F.trim(place), F.lit("")), F.lit(home))
    return _let(F.regexp_replace(d[0], ",+$", ""), lambda a: F.concat_ws(", ", F.nullif(a, F.lit("")), F.when(key_text(F.element_at(F.split(a, ","), -1)) != key_text(d[1]), d[1]), F.lit(country)))
