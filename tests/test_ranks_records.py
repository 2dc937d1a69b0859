"""Exact order statistics in rounds, record round trips, JSON path profile."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearthgrid.operators import profile, ranks, records

@pytest.mark.parametrize("enough", [1_000_000, 40, 1])
def test_places_of_groups_equal_sorting(spark, enough, monkeypatch):
    monkeypatch.setattr(ranks, "CELLS", 8)
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 50)) for _ in range(700)] + [("b", float(rng.randrange(3))) for _ in range(500)] + [("c", 7.0)] * 300 + [("d", 1.0), ("d", None), ("e", None), (None, 5.0), (None, 6.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    N = F.col("n")
    places = {"upper": F.floor(N / 2), "p90": F.floor(0.9 * N + 1e-9), "first": F.lit(0), "last": N - 1, "beyond": N}
    got = {r["g"]: r for r in ranks.ranked_values(df, ["g"], "v", places, enough=enough).collect()}
    assert set(got) == {"a", "b", "c", "d", None}
    for g in ("a", "b", "c", "d"):
        xs = sorted(v for k, v in rows if k == g and v is not None)
        assert (got[g]["n"], got[g]["upper"], got[g]["p90"], got[g]["first"], got[g]["last"], got[g]["beyond"]) == (len(xs), xs[len(xs) // 2], xs[int(0.9 * len(xs) + 1e-9)], xs[0], xs[-1], None)
    down = {r["g"]: r["third"] for r in ranks.ranked_values(df, ["g"], "v", {"third": F.lit(2)}, descending=True, enough=enough).collect()}
    assert down["a"] == sorted((v for k, v in rows if k == "a"), reverse=True)[2] and down["d"] is None


def test_medians_and_no_groups(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", 21.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert {r["g"]: (r["n"], r["median"]) for r in ranks.medians(df, ["g"], "v", 1).collect()} == {"a": (4, 6.0), "b": (3, None)}
    (one,) = ranks.ranked_values(df, [], "v", {"m": F.expr("floor(n / 2)")}).collect()
    assert (one["n"], one["m"]) == (7, statistics.median_high([v for _, v in rows]))
    (none,) = ranks.ranked_values(df.limit(0), [], "v", {"m": F.expr("floor(n / 2)")}).collect()
    assert (none["n"], none["m"]) == (0, None) and ranks.medians(df.limit(0), ["g"], "v").collect() == []


SCHEMA = "id int, price double, fees double, day date, cost double, extras variant"


def test_write_read_write_is_identical(spark):
    schema = StructType.fromDDL(SCHEMA)
    cost = {"cost": F.col("price") + F.coalesce("fees", F.lit(0.0))}
    lines = ['{"id":1,"price":5.0,"fees":2.5,"day":"2026-08-21","cost":99.0,"extras":{"via":["a",{"b":null}],"n":1},"old_key":3}', '{"id":2,"extras":null}', '{"id":"x","price":"y"}', "[1]", "nothing", "", None, '{"id":3']
    first = records.from_lines(spark.createDataFrame([(x,) for x in lines], "value string"), schema, cost, {"fees": 0.5})
    rows = {r["id"]: r for r in first.withColumn("extras", F.to_json("extras")).collect()}
    assert len(rows) == 3 and (rows[1]["cost"], rows[1]["day"].isoformat(), json.loads(rows[1]["extras"])) == (7.5, "2026-08-21", {"via": ["a", {"b": None}], "n": 1})
    assert (rows[2]["fees"], rows[2]["cost"], rows[None]["price"]) == (0.5, None, None)
    written = records.to_lines(first, cost)
    again = records.to_lines(records.from_lines(written, schema, cost, {"fees": 0.5}), cost)
    assert sorted(r["value"] for r in written.collect()) == sorted(r["value"] for r in again.collect())
    assert "old_key" not in "".join(r["value"] for r in written.collect())


def test_paths_of_json(spark):
    texts = ['{"a":1,"b":{"c":[{"price":"9"},{"z":1}],"d":[]}}', '{"a":"x","b":{"c":[{"price":"10"}]}}', '{"a":null}', "[3]", "7", "no json", None, "[" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(r["path"], r["kind"]): (r["n"], r["example"]) for r in profile.json_paths(df.repartition(3), F.col("t")).collect()}
    invalid = got.pop(("", "invalid"))
    assert got == {("a", "number"): (1, "1"), ("a", "string"): (1, "x"), ("a", "null"): (1, "null"), ("b.c[].price", "string"): (2, "10"), ("[]", "number"): (1, "3"), ("", "number"): (1, "7")}
    assert invalid[0] == 2
    assert [r["path"] for r in profile.json_paths(df.where("t like '{%'"), F.col("t"), "PRICE|cost").collect()] == ["b.c[].price"]
