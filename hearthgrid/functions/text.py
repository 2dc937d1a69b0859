"""Text canonicalisation and parsers as columns. Expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝáàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "AAAAAAEEEEIIIIOOOOOUUUUNCYaaaaaaeeeeiiiiooooouuuuncyy"
#: Letters and digits of a human code, without those that are easily confused.
CODE_ALPHABET = "23456789ABCDEFGHJKMNPQRSTUVWXYZ"
#: Number words.
NUMBER_WORDS = {"un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8}
#: Kinds of road that may lead an address, and marks of a house number.
ROAD_WORDS = ("avenida", "avda", "av", "calle", "pasaje", "psje", "camino", "paseo", "alameda")
NUMBER_MARKS = ("numero", "nro", "no", "n")
#: Months by number.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


#: The white space that separates words.
SPACES = r"[\t\n\x0B\f\r ]+"


def fold(c: Column) -> Column:
    """Unaccented, lower case, one space between words, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unaccent(c)), SPACES, " "))


def folded(s: str) -> str:
    """``fold`` of a plain string, for arguments."""
    return " ".join(s.translate(str.maketrans(ACCENTED, PLAIN)).lower().split())


def key_text(c: Column) -> Column:
    """Text for comparison: unaccented, lower case, without points and commas inside numbers, other marks as spaces."""
    t = F.regexp_replace(F.lower(unaccent(F.coalesce(c, F.lit("")))), r"(?<=[0-9])[.,](?=[0-9])", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def locale_number(c: Column) -> Column:
    """Number of a text with points for thousands and a comma for decimals, spaces left out; null if it's none.

    Commas before groups of three digits, twice or more, separate thousands. Else the last comma is a decimal comma, before it
    points count for nothing and nothing is zero. Without a comma, points before groups of three separate thousands, and a
    single other point is a decimal point.
    """
    t = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    without = lambda x, mark: F.replace(x, F.lit(mark), F.lit(""))
    whole = without(F.regexp_extract(t, r"^([0-9.]*),[0-9]+$", 1), ".")
    return (
        F.when(t.rlike(r"^[0-9]{1,3}(,[0-9]{3}){2,}(\.[0-9]+)?$"), without(t, ",").try_cast("double"))
        .when(t.rlike(r"^[0-9.]*,[0-9]+$"), F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), F.regexp_extract(t, "([0-9]+)$", 1)).try_cast("double"))
        .when(t.rlike(r"^[0-9]+(\.[0-9]{3})*$"), without(t, ".").try_cast("double"))
        .when(t.rlike(r"^[0-9]+\.[0-9]+$"), t.try_cast("double"))
    )


def ordered_class(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first pattern that the text matches."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(label)) for label, p in patterns], F.lit(None).cast("string"))


def longest_name(c: Column, names: list[str]) -> Column:
    """The longest of ``names`` that stands in the text as a word (the first by name among equally long ones).

    The dictionary is an argument of bounded size, so it's part of the expression. A pattern starts with the name and looks back from
    its end: texts are searched for the name's characters, where a pattern that starts with what may stand before is tried at each one.
    """
    ordered = sorted(names, key=lambda n: (-len(n), n))
    return F.coalesce(*[F.when(c.rlike(rf"{_quote(n)}(?<![A-Za-z0-9]{_quote(n)})(?![A-Za-z0-9])"), F.lit(n)) for n in ordered], F.lit(None).cast("string"))


def _quote(s: str) -> str:
    return "".join("\\" + x if x in r".^$*+?()[]{}|\-" else x for x in s)


def slug(*parts: Column, limit: int = 90) -> Column:
    """Lower-case words joined by hyphens, cut at ``limit``."""
    joined = F.concat_ws(" ", *parts)
    return F.left(F.btrim(F.regexp_replace(F.lower(unaccent(joined)), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(limit))


def canonical_url(c: Column) -> Column:
    """Host and path in lower case, without scheme, leading www, query, fragment and trailing slash."""
    bare = F.regexp_replace(F.split_part(F.split_part(F.lower(F.trim(c)), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"^[a-z]+://(www\.)?", "")
    return F.regexp_replace(bare, "/+$", "")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def host_in(host: Column, domains: list[str]) -> Column:
    """The host is one of the domains or below one."""
    tests = [(host == d) | F.endswith(host, F.lit("." + d)) for d in domains]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def title_of_url(c: Column) -> Column:
    """Words of the last path part, the first letter in upper case."""
    last = F.regexp_extract(F.regexp_replace(F.split_part(F.split_part(c, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), r"\.[A-Za-z]+$", ""), r"([^/]*)/*$", 1)
    words = F.trim(F.regexp_replace(last, "[^A-Za-z0-9]+", " "))
    return F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2)))


def address_key(address: Column, place: Column) -> Column:
    """Canonical street and number, or an empty text if the address doesn't identify a door.

    Thousands separators, number marks, the leading kind of road, text after a comma and the place's name are dropped; a key
    needs letters and a number of three digits.
    """
    t = F.regexp_replace(F.lower(unaccent(F.split_part(F.coalesce(address, F.lit("")), F.lit(","), F.lit(1)))), r"([0-9])[.]([0-9]{3})", "$1$2")
    t = F.regexp_replace(t, r"[^a-z0-9]+", " ")
    t = F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), rf" ({'|'.join(NUMBER_MARKS)}) (?=[0-9])", " ")
    t = F.regexp_replace(t, rf"^ ({'|'.join(ROAD_WORDS)}) ", " ")
    town = F.regexp_replace(F.lower(unaccent(F.coalesce(place, F.lit("")))), "[^a-z0-9]+", " ")
    t = F.when(F.trim(town) != "", F.replace(t, F.concat(F.lit(" "), F.trim(town), F.lit(" ")), F.lit(" "))).otherwise(t)
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t.rlike(r"(^|[^0-9])[0-9]{3,}") & t.rlike("[a-z]"), t).otherwise("")


def fingerprint(key: Column, place: Column, unit: Column, url: Column, detail: Column) -> Column:
    """Sixteen hex digits of the identity: address key, place and unit.

    Where the address identifies nothing, the url as it stands and the start of the listing's own title or text (``detail``),
    as the cards of one page share its url.
    """
    own = F.concat_ws("|", key, key_text(place), F.nullif(key_text(unit), F.lit("")))
    other = F.concat(F.coalesce(url, F.lit("")), F.lit("|"), F.left(key_text(detail), F.lit(120)))
    return F.left(F.sha1(F.when((key != "") & (F.coalesce(place, F.lit("")) != ""), own).otherwise(other)), F.lit(16))


def human_code(fp: Column, length: int = 5) -> Column:
    """Digits to base 31, the least significant first, of a fingerprint's first twelve hex digits."""
    n = F.conv(F.left(fp, F.lit(12)), 16, 10).cast("bigint")
    return F.concat(*[F.substr(F.lit(CODE_ALPHABET), (F.floor(n / F.lit(31**k)) % 31 + 1).cast("int"), F.lit(1)) if k == 0 else F.substr(F.lit(CODE_ALPHABET), ((n - n % F.lit(31**k)) / F.lit(31**k) % 31 + 1).cast("int"), F.lit(1)) for k in range(length)])


def _first_int(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def _count_word(c: Column, noun: str) -> Column:
    digits = _first_int(c, rf"(?:^|[^0-9.,])([0-9]{{1,2}})\s*(?:{noun})")
    word = F.regexp_extract(c, rf"(?:^|[^a-z])({'|'.join(NUMBER_WORDS)})\s+(?:{noun})", 1)
    return F.coalesce(digits, F.try_element_at(F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair]), word))


def programme(c: Column) -> dict[str, Column]:
    """bedrooms, baths, parking and storage of a description; a number beside the noun, a number word, or the compact 3D/2B."""
    return programme_of(fold(c))


def programme_of(t: Column) -> dict[str, Column]:
    """``programme`` of a text that is folded already, best a column of its own."""
    short = r"(?:^|[^a-z0-9])([0-9]{1,2})\s*d\s*[/+y,-]?\s*([0-9]{1,2})\s*b(?![a-z0-9])"
    parking = F.coalesce(_count_word(t, "estacionamientos?"), F.when(t.rlike("estacionamiento"), 1))
    return {
        "bedrooms": F.coalesce(_count_word(t, "dormitorios?|habitaciones?|dorms?"), _first_int(t, short, 1)),
        "baths": F.coalesce(_count_word(t, "banos?"), _first_int(t, short, 2)),
        "parking": parking,
        "storage": F.when(t.rlike("sin bodega"), False).when(t.rlike("bodega"), True),
    }


def building_age(c: Column, as_of: Column) -> dict[str, Column]:
    """built (year), age, and the age ceiling that phrases for new buildings give."""
    t = fold(c)
    return building_age_of(building_age_texts(t), as_of) | {"age_ceiling": F.when(t.rlike("a estrenar"), 2).when(t.rlike("edificio nuevo"), 5)}


def building_age_texts(folded: Column) -> dict[str, Column]:
    """The year of building and the age as they stand, as integers."""
    return {
        "year": _first_int(folded, r"(?:ano de construccion|construido en|construccion)\D{0,12}((?:19|20)[0-9]{2})"),
        "years": _first_int(folded, r"antiguedad\D{0,12}([0-9]{1,3})\s*anos?"),
    }


def building_age_of(texts: dict[str, Column], as_of: Column) -> dict[str, Column]:
    """``built`` and ``age`` of what ``building_age_texts`` found, best columns of their own."""
    year, age = F.when(texts["year"].between(1900, F.year(as_of) + 1), texts["year"]), texts["years"]
    return {"built": F.coalesce(year, F.year(as_of) - age), "age": F.coalesce(F.when(year.isNotNull(), F.greatest(F.year(as_of) - year, F.lit(0))), age)}


def floor_and_unit(c: Column) -> dict[str, Column]:
    """floor and unit; a unit of three digits or more tells the floor."""
    return floor_and_unit_of(floor_texts(fold(c)))


def floor_texts(folded: Column) -> dict[str, Column]:
    """The unit and the floor as they stand."""
    return {
        "unit": F.nullif(F.regexp_extract(folded, r"(?:depto|departamento|dpto|unidad)\.?\s*(?:n|no|nro|#)?\s*([0-9]{2,4}[a-z]?)(?![a-z0-9])", 1), F.lit("")),
        "said": F.coalesce(_first_int(folded, r"piso\s*([0-9]{1,2})(?![0-9])"), _first_int(folded, r"(?:^|[^0-9])([0-9]{1,2})\s*(?:°|º|er|do|to|vo)?\s*piso")),
    }


def floor_and_unit_of(texts: dict[str, Column]) -> dict[str, Column]:
    """``floor_and_unit`` of what ``floor_texts`` found, best columns of their own."""
    unit, said = texts["unit"], texts["said"]
    digits = F.regexp_extract(F.coalesce(unit, F.lit("")), "^([0-9]{3,4})", 1)
    return {"unit": unit, "floor": F.coalesce(F.when(said.between(1, 60), said), F.floor(F.nullif(digits, F.lit("")).try_cast("int") / 100).cast("int"))}


def areas(c: Column) -> dict[str, Column]:
    """total, useful and terrace areas in square metres.

    A labelled area is what its label says; of two bare ones the larger is the total; a lone bare one is useful. The total is
    deduced from useful and terrace, and dropped if it is below the useful area.
    """
    return areas_of(area_texts(fold(c)))


def area_texts(folded: Column) -> dict[str, Column]:
    """What stands where areas do, as text: useful, total and terrace by label, a plain one, and all bare ones."""
    t = F.regexp_replace(folded, r"mt2|mts2|m²|metros cuadrados", "m2")
    num = r"([0-9]+(?:[.,][0-9]+)?)"
    found = lambda *ps: F.coalesce(*[F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in ps])
    before = lambda label: (rf"{label}\s*:?\s*{num}\s*m2", rf"superficie {label}\s*(?:m2)?\s*:?\s*{num}")
    after = lambda label: rf"{num}\s*m2\s*(?:de\s*)?{label}"
    return {
        "useful": found(*before("util(?:es)?"), after("util(?:es)?")),
        "total": found(*before("total(?:es)?"), after("total(?:es)?")),
        "terrace": found(after("terraza"), *before("terraza")),
        "plain": found(rf"superficie\s*(?:m2)?\s*:?\s*{num}"),
        "bare": F.regexp_extract_all(t, F.lit(rf"{num}\s*m2"), F.lit(1)),
    }


def areas_of(texts: dict[str, Column]) -> dict[str, Column]:
    """``areas`` of what ``area_texts`` found, best columns of their own."""
    useful, total, terrace, plain = (locale_number(texts[k]) for k in ("useful", "total", "terrace", "plain"))
    bare = F.transform(texts["bare"], locale_number)
    labelled, n = texts["useful"].isNotNull() | texts["total"].isNotNull(), F.size(texts["bare"])
    useful = F.coalesce(useful, F.when(~labelled, F.coalesce(F.array_min(bare), plain)))
    total = F.coalesce(total, F.when(~labelled & (n >= 2), F.array_max(bare)), useful + terrace)
    return {"total": F.when(F.coalesce(total >= useful, F.lit(True)), total), "useful": useful, "terrace": terrace}


def spoken_date(c: Column, as_of: Column) -> Column:
    """Date of a text: 12 de julio 2026, dd/mm/yy, or hace N días, semanas, meses, horas (up to 400)."""
    t = fold(c)
    month = F.coalesce(*[F.when(F.regexp_extract(t, r"[0-9]{1,2} de ([a-z]+)", 1) == m, i + 1) for i, m in enumerate(MONTHS)])
    long_ = F.try_to_date(F.concat_ws("-", F.regexp_extract(t, r"([0-9]{1,2}) de [a-z]+(?: de| del)? ([0-9]{4})", 2), month.cast("string"), F.regexp_extract(t, r"([0-9]{1,2}) de [a-z]+", 1)), "yyyy-M-d")
    slash = r"(?:^|[^0-9])([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4}|[0-9]{2})(?:[^0-9]|$)"
    year = _first_int(t, slash, 3)
    short = F.try_to_date(F.concat_ws("-", F.when(year < 100, year + 2000).otherwise(year).cast("string"), F.regexp_extract(t, slash, 2), F.regexp_extract(t, slash, 1)), "yyyy-M-d")
    n = _first_int(t, r"hace ([0-9]{1,4}) (?:dias?|semanas?|mes(?:es)?|horas?)")
    unit = F.regexp_extract(t, r"hace [0-9]{1,4} (dia|semana|mes|hora)", 1)
    days = n * F.when(unit == "dia", 1).when(unit == "semana", 7).when(unit == "mes", 30).otherwise(0)
    return F.coalesce(long_, short, F.when(n <= 400, F.date_sub(as_of, days)))


def map_pin(c: Column) -> Column:
    """struct(lat, lon) of the first pair on a map link that lies in the box from 56 to 17 south and 76 to 66 west."""
    plain = F.regexp_extract_all(c, F.lit(r"(?:q=|center=|ll=)(-?[0-9]+\.[0-9]+,-?[0-9]+\.[0-9]+)"), F.lit(1))
    marked = F.transform(F.regexp_extract_all(c, F.lit(r"(!2d-?[0-9.]+!3d-?[0-9.]+)"), F.lit(1)), lambda x: F.concat_ws(",", F.regexp_extract(x, "!3d(-?[0-9.]+)", 1), F.regexp_extract(x, "!2d(-?[0-9.]+)", 1)))
    pairs = F.transform(F.concat(plain, marked), lambda x: F.struct(F.split_part(x, F.lit(","), F.lit(1)).try_cast("double").alias("lat"), F.split_part(x, F.lit(","), F.lit(2)).try_cast("double").alias("lon")))
    return F.get(F.filter(pairs, lambda p: p["lat"].between(-56, -17) & p["lon"].between(-76, -66)), F.lit(0))


def rate_cascade(candidates: list[tuple[str, Column]], low: float = 20_000, high: float = 100_000, constant: float = 40_800.0) -> tuple[Column, Column]:
    """(value, where it comes from): the first candidate inside the band, else the constant."""
    value = F.coalesce(*[F.when(v.between(low, high), v) for _, v in candidates], F.lit(constant))
    return value, F.coalesce(*[F.when(v.between(low, high), F.lit(k)) for k, v in candidates], F.lit("constant"))


def pages_of(url: Column, param: str, pages: int, first: int = 1) -> Column:
    """Array of the urls of a listing's pages: the first as it stands, then the page parameter replaced or added."""
    def nth(n: Column) -> Column:
        value = (n + (first - 1)).cast("string")
        replaced = F.regexp_replace(url, F.lit(rf"([?&]){param}=[^&#]*"), F.concat(F.lit(f"$1{param}="), value))
        added = F.concat(url, F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise("?"), F.lit(param + "="), value)
        return F.when(n == 1, url).when(url.rlike(rf"[?&]{param}="), replaced).otherwise(added)

    return F.transform(F.sequence(F.lit(1), F.lit(pages)), nth)
