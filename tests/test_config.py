"""Hand-edited files: typed rows, and all errors of a file in one reading."""

import json

import pytest

pytest.importorskip("yaml")
from hearthgrid.sources import config

SOURCES = """
fuentes:
  - {id: uno, nombre: Uno, urls: [https://a.example/x], detalle: {patron: ficha, max: 3}, activa: false}
  - {id: dos, nombre: Dos, urls: https://b.example}
"""
BAD_SOURCES = """
fuentes:
  - {id: uno, nombre: Uno, urls: [a]}
  - {id: uno, nombre: Otra, urls: [b], motro: navegador}
  - {nombre: Sin id, activa: quizas}
  - nada
"""
OVERRIDES = """
departamentos:
  - {codigo: " #abc12 ", estado: Visita, gastos_comunes_clp: 250000, nota: "  llamé "}
  - {codigo: XYZ89, estado: descartado, ano_construccion: "2015"}
"""
BAD_OVERRIDES = """
departamentos:
  - {codigo: A, estado: quizas, piso: 99, banos: dos, direccion: x}
  - {codigo: a}
  - {estado: visto}
  - 3
"""
PROFILE = {"requisitos": {"tipo": ["casa"], "m2_totales": {"min": 90}, "arriendo_clp": {"max": 5}}, "comunas": {"nucleo": ["x"]}, "ancla": {"lat": -33.0, "lon": -70.0}, "radio_km": {"preferente": 1, "anillo": 2}, "antiguedad": {"ideal_max": 5, "aceptable_max": 20}}


@pytest.fixture(scope="module")
def read(spark):
    spark.dataSource.register(config.YamlConfig)
    return lambda kind, path: spark.read.format("yaml_config").option("kind", kind).load(str(path))


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return folder / name


def test_sources_are_typed_and_have_defaults(read, tmp_path):
    rows = {r["id"]: r for r in config.valid(read("sources", put(tmp_path, "s.yml", SOURCES))).collect()}
    assert rows["uno"]["urls"] == ["https://a.example/x"] and rows["uno"]["activa"] is False and json.loads(rows["uno"]["detalle"]) == {"patron": "ficha", "max": 3}
    assert rows["dos"]["urls"] == ["https://b.example"] and (rows["dos"]["motor"], rows["dos"]["operacion_default"], rows["dos"]["selector_link"], rows["dos"]["activa"]) == ("requests", "arriendo", "a", True)


def test_all_errors_of_a_file_at_once_and_other_files_stay(read, tmp_path):
    put(tmp_path, "bad.yml", BAD_SOURCES)
    put(tmp_path, "good.yaml", SOURCES)
    put(tmp_path, "broken.yml", "fuentes: [")
    put(tmp_path, "empty.yml", "")
    rows = read("sources", tmp_path)
    errors = {r["file"].rsplit("/", 1)[1] + str(r["entry"]): r["errors"] for r in rows.where("size(errors) > 0").collect()}
    assert set(errors) == {"bad.yml2", "bad.yml3", "bad.yml4", "broken.yml0", "empty.yml0"}
    assert len(errors["bad.yml2"]) == 2 and len(errors["bad.yml3"]) == 3 and "motro" in errors["bad.yml2"][1]
    assert {r["id"] for r in config.valid(rows).collect()} == {"uno", "dos"}


def test_overrides(read, tmp_path):
    rows = {r["codigo"]: r for r in config.valid(read("overrides", put(tmp_path, "g.yml", OVERRIDES))).collect()}
    assert (rows["ABC12"]["estado"], rows["ABC12"]["nota"], rows["ABC12"]["gastos_comunes_clp"], rows["XYZ89"]["ano_construccion"]) == ("visita", "llamé", 250_000.0, 2015.0)
    bad = {r["entry"]: r["errors"] for r in read("overrides", put(tmp_path, "b.yml", BAD_OVERRIDES)).collect()}
    assert {k: len(v) for k, v in bad.items()} == {1: 4, 2: 1, 3: 1, 4: 1}
    assert read("overrides", tmp_path / "nowhere.yml").count() == 0 and read("overrides", put(tmp_path, "e.yml", "")).count() == 0
    assert read("overrides", put(tmp_path, "l.yml", "departamentos: x")).collect()[0]["errors"]


@pytest.mark.parametrize(
    ("change", "errors"),
    [({}, 0), ({"requisitos": None}, 1), ({"requisitos": {"tipo": []}}, 1), ({"requisitos": {"tipo": ["x"], "dormitorios": 3}}, 1), ({"requisitos": {"tipo": ["x"], "dormitorios": {"min": 4, "max": 3}, "arriendo_clp": {"max": 0}, "comparar": "nada"}}, 3), ({"ancla": {"lat": 91, "lon": 0}}, 1), ({"ancla": {"lat": 1}}, 1), ({"radio_km": {"preferente": 3, "anillo": 2}}, 1), ({"antiguedad": {"ideal_max": 9, "bueno_max": 5}}, 1), ({"comunas": {}}, 1), ({"requisitos": None, "comunas": None, "ancla": {"lat": "x"}}, 3)],
)
def test_profile_errors(change, errors):
    assert len(config.profile_errors(PROFILE | change)) == errors


def test_profile_is_one_row(read, tmp_path):
    (row,) = config.valid(read("profile", put(tmp_path, "p.yml", json.dumps(PROFILE)))).collect()
    assert json.loads(row["profile"]) == PROFILE
    with pytest.raises(Exception, match="no profile file"):
        read("profile", tmp_path / "nowhere.yml").collect()
