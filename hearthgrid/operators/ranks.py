"""Exact order statistics of groups of any size: ranges are counted until the one that holds the wanted place is small.

Each round cuts what is left of a group at grid points from a sketch, counts the cells exactly, and keeps the cell of the wanted place.
The sketch only chooses the cuts, so the result is exact. What is left after a round is about a ``CELLS``-th of a group; once it
is ``ENOUGH`` rows at most it is counted by value and the place is found there. Counts are made before the shuffle, so no task ever
holds or sorts a group. Small groups, the usual case, take no round at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS, ENOUGH, ROUNDS = 256, 1_000_000, 6


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys are equal, as they are in a grouping."""
    side = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(side, on, how).drop(*[f"_k_{k}" for k in keys])


def _within(df: DataFrame, state: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of each group and place that are still in question: above ``_low`` (null: no bound) and up to ``_high``."""
    inside = (F.col("_low").isNull() | (F.col(value) > F.col("_low"))) & (F.col("_high").isNull() | (F.col(value) <= F.col("_high")))
    return _joined(df, state, keys).where(inside)


def ranked_values(df: DataFrame, keys: list[str], value: str, places: dict[str, Column], descending: bool = False, enough: int = ENOUGH) -> DataFrame:
    """(keys, n, and for each name of ``places`` the value at that place, counted from zero) of the known values of each group.

    A place is an expression of ``n``, the number of known values; outside of 0 to n - 1 its value is null. Groups without a known
    value have no row, except that without ``keys`` there is always one row. NaN counts as the largest value.
    """
    if not keys:
        whole = ranked_values(df.select(F.lit(0).alias("_all"), value), ["_all"], value, places, descending, enough)
        return whole.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(k).alias(k) for k in places])
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value))
    n = known.groupBy(*keys).agg(F.count("*").alias("n"))
    at = {k: (F.col("n") - 1 - p if descending else p).cast("long") for k, p in places.items()}
    state = n.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), p.alias("_at")) for k, p in at.items()])).alias("_p"), F.col("n").alias("_left"))
    kind = df.schema[value].dataType
    state = state.select(*keys, "_p._name", F.col("_p._at").alias("_to"), F.lit(None).cast(kind).alias("_low"), F.lit(None).cast(kind).alias("_high"), "_left").where("_to >= 0 and _to < _left")
    most = n.agg(F.max("n")).first()[0] or 0
    for _ in range(ROUNDS):
        if most <= enough:
            break
        state, before, most = _narrowed(known, state, keys, value), most, None
        state = state.checkpoint() if state.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else state.persist()
        most = state.agg(F.max("_left")).first()[0] or 0
        if most >= before:  # one value makes up all that is left
            break
    names = [*keys, "_name"]
    counted = _within(known, state, keys, value).groupBy(*names, F.col(value).alias("_v")).agg(F.count("*").alias("_c"), F.first("_to").alias("_to"))
    upto = F.sum("_c").over(Window.partitionBy(*names).orderBy("_v"))
    hit = counted.withColumn("_upto", upto).where((F.col("_upto") > F.col("_to")) & (F.col("_upto") - F.col("_c") <= F.col("_to")))
    got = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in places])
    return _joined(n, got, keys, "left")


def _narrowed(known: DataFrame, state: DataFrame, keys: list[str], value: str) -> DataFrame:
    names = [*keys, "_name"]
    inside = _within(known, state, keys, value)
    grid = inside.groupBy(*names).agg(F.array_distinct(F.percentile_approx(value, [k / CELLS for k in range(1, CELLS)], 10 * CELLS)).alias("_grid"))
    cut = _joined(state, grid, names)
    cell = F.size(F.filter("_grid", lambda g: g < F.col(value)))  # cell k: above the k-th grid point, up to the next
    counts = _within(known, cut, keys, value).groupBy(*names, cell.alias("_cell")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*names).orderBy("_cell")  # CELLS rows at most
    counts = counts.withColumn("_upto", F.sum("_c").over(order))
    counts = _joined(counts, cut, names)
    hit = counts.where((F.col("_upto") > F.col("_to")) & (F.col("_upto") - F.col("_c") <= F.col("_to")))
    point = lambda k: F.get("_grid", k)
    return hit.select(*names, (F.col("_to") - (F.col("_upto") - F.col("_c"))).alias("_to"), F.coalesce(point(F.col("_cell") - 1), F.col("_low")).alias("_low"), F.coalesce(point(F.col("_cell")), F.col("_high")).alias("_high"), F.col("_c").alias("_left"))


def medians(df: DataFrame, keys: list[str], value: str, digits: int = 0, least: int = 4, name: str = "median") -> DataFrame:
    """(keys, n, median): interpolating median rounded half-even, null below ``least`` known values."""
    both = ranked_values(df, keys, value, {"_lower": F.floor((F.col("n") - 1) / 2), "_upper": F.floor(F.col("n") / 2)})
    middle = (F.col("_lower") + F.col("_upper")) / 2
    return both.select(*keys, "n", F.when(F.col("n") >= least, F.bround(middle, digits)).alias(name))
