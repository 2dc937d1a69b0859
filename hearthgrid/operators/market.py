"""Market statistics: guarded medians, order statistics, histograms, coverage, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A statistic over fewer values than this isn't reported.
LEAST = 4


def guarded_median(c: Column, digits: int = 0, least: int = LEAST) -> Column:
    """Interpolating median rounded half-even; null below ``least`` values."""
    return F.when(F.count(c) >= least, F.bround(F.median(c), digits))


def positive(c: str) -> Column:
    """The column with zero read as unknown."""
    return F.when(F.col(c) != 0, F.col(c))


def trailing_summary(events: DataFrame, when: str, as_of: Column, days: int, counts: dict[str, Column], measures: dict[str, Column]) -> DataFrame:
    """One row over the days from ``days`` before ``as_of``, that day included: how often each test of ``counts`` holds, and a
    guarded median, to whole numbers, of each measure (null where an event doesn't count for it)."""
    recent = events.where((F.col(when) >= F.date_sub(as_of, days)) & (F.col(when) <= as_of))
    return recent.agg(*[F.count_if(c).alias(k) for k, c in counts.items()], *[guarded_median(m).alias(k) for k, m in measures.items()])


def typical_fee(fee: Column, area: Column, wanted_area: float, least: int = LEAST) -> Column:
    """Median fee per unit of area times the wanted area, else the plain median fee, to the nearest ten thousand; else null.

    A fee of zero isn't one, and neither is an area of zero or less.
    """
    plain = F.when(fee != 0, fee)
    rate = F.when(area > 0, plain / area)
    return F.when(F.count(rate) >= least, F.bround(F.median(rate) * wanted_area, -4)).when(F.count(plain) >= least, F.bround(F.median(plain), -4))


def monthly_counts(df: DataFrame, when: str) -> DataFrame:
    return df.groupBy(F.date_format(when, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, width: float, least: int = LEAST) -> DataFrame:
    """(bin, n) with bins of ``width``; no rows where fewer than ``least`` values are known."""
    known = df.where(F.col(value).isNotNull())
    total = known.select(F.count("*")).scalar()
    return known.groupBy((F.floor(F.col(value) / width) * width).cast("double").alias("bin")).agg(F.count("*").alias("n")).where(total >= least)


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, pct): whole percent of rows in which the field is neither null nor an empty string."""
    share = [F.floor(100 * F.try_divide(F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")), F.count("*"))).cast("long").alias(c) for c in columns]
    return df.agg(*share).unpivot([], columns, "field", "pct")


def calibration(df: DataFrame, source: str, core: Column, passes: Column, rank: list[Column], key: str, top: int = 3) -> DataFrame:
    """For each source: rows, rows in the core zone, rows that pass, and the keys of its best rows in order."""
    counts = df.groupBy(source).agg(F.count("*").alias("n"), F.count_if(core).alias("n_core"), F.count_if(passes).alias("n_pass"))
    best = df.withColumn("_k", F.row_number().over(Window.partitionBy(source).orderBy(*rank))).where(F.col("_k") <= top)
    best = best.groupBy(source).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.col(key).cast("string").alias("v")))), lambda x: x["v"]), ",").alias("best"))
    return counts.join(best, source, "left")


def top_k_with_carry_over(df: DataFrame, group: str | None, rank: list[Column], k: int) -> DataFrame:
    """Every row with its rank; the first k are sent now, the rest wait for the next run."""
    over = Window.partitionBy(group) if group else Window.partitionBy()
    ranked = df.withColumn("rank", F.row_number().over(over.orderBy(*rank)))
    return ranked.withColumn("pending", F.col("rank") > k)


def retain_last(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last n rows by ``order`` (largest first); a top-n, so nothing is sorted whole."""
    return df.orderBy(*order).limit(n)


def first_per_key(df: DataFrame, key: str, rank: list[Column]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*rank))).where("_k = 1").drop("_k")


def viewport(df: DataFrame, lat: str, lon: str, near: Column) -> DataFrame:
    """Bounding box of the points for which ``near`` holds."""
    return df.where(near).agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))


def spread_coincident(df: DataFrame, lat: str, lon: str, order: str, step: float = 1.4e-4) -> DataFrame:
    """Rows at the same rounded point are moved apart along a spiral; the first stays."""
    n = F.row_number().over(Window.partitionBy(F.round(lat, 5), F.round(lon, 5)).orderBy(order)) - 1
    moved = df.withColumn("nth", n.cast("long"))
    shift = lambda f: F.when(F.col("nth") > 0, step * f(2.4 * F.col("nth"))).otherwise(0.0)
    return moved.withColumns({"lat_shown": F.col(lat) + shift(F.sin), "lon_shown": F.col(lon) + shift(F.cos)})
