"""Hand-edited YAML files as tables: the catalog of sources, the search profile, and what a person found out about a home.

``spark.dataSource.register(YamlConfig)``, then ``spark.read.format("yaml_config").option("kind", "sources").load(path)``. Every row has
``file``, ``entry`` (its place, from 1) and ``errors``, and all of a file's errors come in one reading, so a person mends them at once:
``.where("size(errors) > 0")`` is the table of errors, ``valid`` the rows to work with. A file that isn't YAML, or misses what it has
to hold, is one row with entry 0. The files are small and are read where the plan is made, so executors needn't see them; ``path`` may
be a file, a folder or a pattern, and a missing file is an error for sources and profile and no entries for overrides.

PyYAML is needed for reading only, not for importing this module.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: States that a person gives a home, and the range of each value that may be filled in by hand.
STATES = ("descartado", "visto", "contactado", "visita")
RANGES = {
    "gastos_comunes_clp": (10_000, 2_000_000),
    "ano_construccion": (1900, 2100),
    "antiguedad_anos": (0, 120),
    "piso": (1, 60),
    "dormitorios": (1, 15),
    "banos": (1, 15),
    "estacionamientos": (0, 10),
    "m2_totales": (20, 2_000),
    "m2_utiles": (20, 2_000),
}
#: Fields of a source, with the type and the default of each.
SOURCE_FIELDS = {
    "id": ("string", None),
    "nombre": ("string", None),
    "urls": ("array<string>", None),
    "operacion_default": ("string", "arriendo"),
    "comuna_default": ("string", ""),
    "motor": ("string", "requests"),
    "acciones": ("string", []),
    "paginacion": ("string", {}),
    "detalle": ("string", {}),
    "selector_card": ("string", ""),
    "selector_link": ("string", "a"),
    "activa": ("boolean", True),
    "ignorar_robots": ("boolean", False),
    "entrega_variable": ("boolean", False),
    "url_confirmada": ("boolean", False),
    "notas": ("string", ""),
}
_AT = "file string, entry int, errors array<string>"
SCHEMAS = {
    "sources": f"{_AT}, " + ", ".join(f"{k} {t}" for k, (t, _) in SOURCE_FIELDS.items()),
    "overrides": f"{_AT}, codigo string, estado string, nota string, " + ", ".join(f"{k} double" for k in RANGES),
    "profile": f"{_AT}, profile string",
}


def _typed(value: object, kind: str) -> tuple[object, bool]:
    """(value as its type, whether it fits). Lists and blocks become JSON where text is asked for."""
    if kind == "boolean":
        return (value, True) if isinstance(value, bool) else (None, False)
    if kind == "array<string>":
        return ([str(x) for x in value], True) if isinstance(value, list) else ([value], True) if isinstance(value, str) else (None, False)
    return (json.dumps(value, ensure_ascii=False), True) if isinstance(value, (dict, list)) else (str(value), True)


def _source_rows(data: object) -> Iterator[tuple[int, list[str], dict]]:
    entries = data.get("fuentes") if isinstance(data, dict) else None
    if not isinstance(entries, list) or not entries:
        yield 0, ["no sources are defined under 'fuentes'"], {}
        return
    seen: set[str] = set()
    for n, d in enumerate(entries, 1):
        if not isinstance(d, dict):
            yield n, [f"source {n} is no block of fields"], {}
            continue
        own, row, errors = d.get("id"), {}, []
        name = f"source {n} ('{own}')" if own else f"source {n}"
        if not own:
            errors.append(f"{name} has no 'id'")
        elif str(own) in seen:
            errors.append(f"{name} repeats an id")
        seen.add(str(own))
        if not d.get("urls"):
            errors.append(f"{name} has no 'urls'")
        if not d.get("nombre"):
            errors.append(f"{name} has no 'nombre'")
        errors += [f"{name} has an unknown field '{k}'" for k in sorted(set(map(str, d)) - set(SOURCE_FIELDS))]
        for k, (kind, default) in SOURCE_FIELDS.items():
            if (value := d.get(k, default)) is not None:
                row[k], fits = _typed(value, kind)
                if not fits:
                    errors.append(f"{name}: '{k}' has to be of type {kind}")
        yield n, errors, row


def _override_rows(data: object) -> Iterator[tuple[int, list[str], dict]]:
    entries = (data or {}).get("departamentos") if isinstance(data or {}, dict) else 0
    if not isinstance(entries or [], list):
        yield 0, ["'departamentos' has to be a list"], {}
        return
    seen: set[str] = set()
    for n, d in enumerate(entries or [], 1):
        if not isinstance(d, dict):
            yield n, [f"entry {n} is no block of fields"], {}
            continue
        code = str(d.get("codigo") or "").strip().lstrip("#").upper()
        name, errors = f"[{code}]" if code else f"entry {n}", []
        row = {"codigo": code or None, "estado": str(d.get("estado") or "").strip().lower(), "nota": str(d.get("nota") or "").strip()}
        if not code:
            errors.append(f"{name} has no 'codigo'")
        elif code in seen:
            errors.append(f"{name} is there twice")
        seen.add(code)
        if row["estado"] and row["estado"] not in STATES:
            errors.append(f"{name} state '{row['estado']}' is none of {', '.join(STATES)}")
        for k, (low, high) in RANGES.items():
            if d.get(k) is None:
                continue
            try:
                value = float(d[k])
            except (TypeError, ValueError):
                errors.append(f"{name} {k} has to be a number, not {d[k]!r}")
                continue
            if low <= value <= high:
                row[k] = value
            else:
                errors.append(f"{name} {k}={value:g} is outside {low} to {high}")
        errors += [f"{name} has an unknown field '{k}'" for k in sorted(set(map(str, d)) - set(RANGES) - {"codigo", "estado", "nota"})]
        yield n, errors, row


def profile_errors(p: object) -> list[str]:
    """Everything that would leave a search running but wrong."""
    if not isinstance(p, dict):
        return ["the profile is no block of fields"]
    block = lambda x: x if isinstance(x, dict) else {}
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    out, asked = [], block(p.get("requisitos"))
    if not asked:
        out.append("the profile defines no 'requisitos'")
    elif not asked.get("tipo"):
        out.append("'requisitos.tipo' is empty")
    for k in ("m2_totales", "dormitorios", "arriendo_clp"):
        if asked.get(k) is None:
            continue
        if not isinstance(asked[k], dict):
            out.append(f"'requisitos.{k}' has to be a range with min and max")
            continue
        low, high = asked[k].get("min"), asked[k].get("max")
        out += [f"'requisitos.{k}.{end}' has to be a number" for end, x in (("min", low), ("max", high)) if x is not None and not number(x)]
        if number(low) and number(high) and low > high:
            out.append(f"'requisitos.{k}': min ({low}) is above max ({high})")
    if number(top := block(asked.get("arriendo_clp")).get("max")) and top <= 0:
        out.append("'requisitos.arriendo_clp.max' has to be positive")
    if asked.get("comparar", "arriendo") not in ("arriendo", "total"):
        out.append("'requisitos.comparar' has to be 'arriendo' or 'total'")
    lat, lon = (block(p.get("ancla")).get(k) for k in ("lat", "lon"))
    if lat is not None and not (number(lat) and number(lon) and -90 <= lat <= 90 and -180 <= lon <= 180):
        out.append(f"the coordinates of 'ancla' are out of range: {lat}, {lon}")
    near, ring = (block(p.get("radio_km")).get(k) for k in ("preferente", "anillo"))
    if near and ring and near > ring:
        out.append("'radio_km.preferente' is above 'radio_km.anillo'")
    ages = [x for k in ("ideal_max", "bueno_max", "aceptable_max") if (x := block(p.get("antiguedad")).get(k)) is not None]
    if ages != sorted(ages):
        out.append("the steps of 'antiguedad' have to rise: ideal_max, bueno_max, aceptable_max")
    if not block(p.get("comunas")).get("nucleo"):
        out.append("'comunas.nucleo' is empty")
    return out


def _profile_rows(data: object) -> Iterator[tuple[int, list[str], dict]]:
    yield 1, profile_errors(data), {"profile": json.dumps(data, ensure_ascii=False, default=str)}


_ROWS = {"sources": _source_rows, "overrides": _override_rows, "profile": _profile_rows}


def rows_of_text(kind: str, text: str) -> Iterator[tuple[int, list[str], dict]]:
    """(entry, errors, fields) of one file's text."""
    import yaml

    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        yield 0, [f"not YAML: {str(e).splitlines()[0]}"], {}
        return
    yield from _ROWS[kind](data)


class _File(InputPartition):
    def __init__(self, name: str, text: str):
        self.name, self.text = name, text


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str, schema: StructType):
        self.kind, self.path, self.names = kind, path.removeprefix("file://"), [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        found = [self.path] if os.path.isfile(self.path) else sorted(f for end in ("yml", "yaml") for f in glob.glob(os.path.join(self.path, f"*.{end}"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found and self.kind != "overrides":
            raise FileNotFoundError(f"no {self.kind} file at {self.path}")
        out = []
        for f in found:
            with open(f, encoding="utf-8") as text:
                out.append(_File(f, text.read()))
        return out or [_File("", "")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.name:
            return
        for entry, errors, fields in rows_of_text(self.kind, partition.text):
            yield tuple(({"file": partition.name, "entry": entry, "errors": errors} | fields).get(k) for k in self.names)


class YamlConfig(DataSource):
    """Format ``yaml_config``; option ``kind``: sources, overrides or profile."""

    @classmethod
    def name(cls) -> str:
        return "yaml_config"

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in SCHEMAS:
            raise ValueError(f"option 'kind' has to be one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._kind(), self.options.get("path", ""), schema)


def valid(rows: DataFrame) -> DataFrame:
    """The entries of files without any error; a file with one is left out whole, as half a catalog is a wrong catalog."""
    bad = rows.where("size(errors) > 0").select("file").distinct()
    return rows.join(bad, "file", "left_anti").where("entry > 0").drop("errors")
