"""State between runs: lookup, upsert, run differences, absence counters, ledgers, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are known and no other row's."""
    one = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return df.join(one, keys, "left_semi")


def tiered_lookup(df: DataFrame, state: DataFrame, tiers: list[list[str]], learn: list[str], order: str) -> DataFrame:
    """Fills unknown ``learn`` columns from one state row: that of the first tier of keys that has it.

    Where state rows share the keys of the first tier, the last by ``order`` answers; keys of every tier after it count only
    where a single state row has them. Columns outside ``learn``, such as
    prices, are never inherited. ``tier`` tells which tier answered (from 1), null if none.
    """
    out = df
    for i, keys in enumerate(tiers, 1):
        held = F.struct(*[F.col(c) for c in learn])
        if i == 1:
            side = state.groupBy(*keys).agg(F.max_by(held, F.struct(order, held)).alias(f"_s{i}"))
        else:
            side = unique_by(state, keys).select(*keys, held.alias(f"_s{i}"))
        out = out.join(side, keys, "left")
    found = F.coalesce(*[F.col(f"_s{i}") for i in range(1, len(tiers) + 1)])
    tier = F.coalesce(*[F.when(F.col(f"_s{i}").isNotNull(), i) for i in range(1, len(tiers) + 1)])
    out = out.withColumn("_s", found).withColumn("tier", tier).withColumns({c: F.coalesce(F.col(c), F.col("_s")[c]) for c in learn})
    return out.select(*df.columns, "tier")


def override(df: DataFrame, manual: DataFrame, key: str, columns: list[str], state: str) -> DataFrame:
    """Manual values win over the data; a manual state ``descartado`` forces ``discarded``."""
    side = manual.select(key, *[F.col(c).alias(f"_m_{c}") for c in columns], F.col(state).alias("_state"))
    out = df.join(side, key, "left").withColumns({c: F.coalesce(F.col(f"_m_{c}"), F.col(c)) for c in columns})
    return out.withColumn("discarded", F.coalesce(F.col("_state") == "descartado", F.lit(False))).select(*df.columns, "discarded")


def run_diff(seen: DataFrame, before: DataFrame, key: str, price: str) -> DataFrame:
    """(key, event, price, before): ``alta`` for a key unknown to the state, ``precio`` where two known prices differ."""
    old = before.select(key, F.col(price).alias("before"), F.lit(True).alias("_had"))
    both = seen.select(key, price).join(old, key, "left")
    event = F.when(F.col("_had").isNull(), "alta").when(F.col(price) != F.col("before"), "precio")
    return both.withColumn("event", event).where("event is not null").select(key, "event", price, "before")


def count_absences(state: DataFrame, seen: DataFrame, live_sources: DataFrame, key: str, source: str, counter: str, gone_at: int = 3) -> DataFrame:
    """The state with its counter moved by one run, and ``gone`` exactly when the counter reaches ``gone_at``.

    A seen key starts again at zero; an unseen one counts only if its source delivered in this run.
    """
    out = state.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    out = out.join(live_sources.select(source).distinct().withColumn("_live", F.lit(True)), source, "left")
    after = F.when(F.col("_seen").isNotNull(), 0).when(F.col("_live").isNotNull(), F.col(counter) + 1).otherwise(F.col(counter))
    out = out.withColumn("_after", after).withColumn("gone", (F.col("_after") == gone_at) & (F.col("_after") != F.col(counter)))
    return out.withColumn(counter, F.col("_after")).select(*state.columns, "gone")


def departures(events: DataFrame, source: str, key: str, run: str, gone_at: int = 3) -> DataFrame:
    """(source, key, gone_on): the run in which a key was missed for the ``gone_at``-th time in a row, for every spell of absence.

    A run counts for a source only if the source delivered anything in it. Live runs are numbered for each source, and the
    gap to a key's next number tells how many it missed, so a key has one row for each run it was seen in and no others.
    """
    seen = events.select(source, key, run).distinct()
    live = seen.select(source, run).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy(run)))
    last = live.groupBy(source).agg(F.max("_n").alias("_end"))
    numbered = seen.join(live, [source, run]).join(last, source)
    following = F.coalesce(F.lead("_n").over(Window.partitionBy(source, key).orderBy("_n")), F.col("_end") + 1)
    gone = numbered.withColumn("_next", following).where(F.col("_next") - F.col("_n") > gone_at).select(source, key, (F.col("_n") + gone_at).alias("_n"))
    return gone.join(live.withColumnRenamed(run, "gone_on"), [source, "_n"]).select(source, key, "gone_on")


def upsert(state: DataFrame, seen: DataFrame, key: str, as_of: Column, price: str) -> DataFrame:
    """The next snapshot (key, price, first_seen, last_seen, times_seen, was_alerted, pending): all keys of both sides."""
    new = seen.select(key, F.col(price).alias("_price"), F.col("alerted").alias("_alerted"), F.col("failed").alias("_failed"), F.lit(True).alias("_seen"))
    out = state.join(new, key, "full")
    was = F.coalesce("was_alerted", F.lit(False)) | F.coalesce("_alerted", F.lit(False))
    return out.select(
        key,
        F.coalesce("_price", F.col(price)).alias(price),
        F.coalesce("first_seen", as_of).alias("first_seen"),
        F.when(F.col("_seen"), as_of).otherwise(F.col("last_seen")).alias("last_seen"),
        (F.coalesce("times_seen", F.lit(0)) + F.when(F.col("_seen"), 1).otherwise(0)).alias("times_seen"),
        was.alias("was_alerted"),
        (~was & F.coalesce("_failed", "pending", F.lit(False))).alias("pending"),
    )


def purge(state: DataFrame, last_seen: str, as_of: Column, days: int = 120) -> DataFrame:
    """Rows seen within the days, and rows whose date is unknown."""
    return state.where(F.col(last_seen).isNull() | (F.col(last_seen) >= F.date_sub(as_of, days)))


def latest_prior(df: DataFrame, group: str, order: list[str], event: Column, identity: str, value: str) -> DataFrame:
    """Adds ``prior``: ``value`` of the last earlier row of the group for which ``event`` holds and whose identity is another.

    Events fall into runs of one identity; the answer is the last event, or where that has the row's own identity the last one
    of the run before. Both are carried along one sort of the group; a null group has no past.
    """
    w = Window.partitionBy(group).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    own = F.struct(F.col(identity).alias("i"), F.col(value).alias("v"))
    out = df.withColumn("_e", F.when(event, own)).withColumn("_last", F.last("_e", ignorenulls=True).over(before))
    # at the first event of a run: the last event of the run before it
    start = F.when(F.col("_e").isNotNull() & F.col("_last").isNotNull() & ~F.col("_e.i").eqNullSafe(F.col("_last.i")), F.col("_last"))
    out = out.withColumn("_start", start).withColumn("_run", F.last("_start", ignorenulls=True).over(before))
    prior = F.when(F.col(group).isNull(), None).when(F.col("_last.i").eqNullSafe(F.col(identity)), F.col("_run.v")).otherwise(F.col("_last.v"))
    return out.withColumn("prior", prior).drop("_e", "_last", "_start", "_run")


def change_points(df: DataFrame, group: str, order: list[str], value: str, last: int = 12) -> DataFrame:
    """(group, points, days): the last ``last`` values that differ from the one before them, in order, and the dates they began
    (the first of ``order`` as a date)."""
    previous = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    moved = df.where(F.col(value).isNotNull()).withColumn("_p", previous).where(F.col("_p").isNull() | (F.col("_p") != F.col(value)))
    recent = moved.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(o) for o in order]))).where(F.col("_n") <= last)
    out = recent.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, value))).alias("_all"))
    return out.select(group, F.transform("_all", lambda x: x[value]).alias("points"), F.transform("_all", lambda x: F.to_date(x[order[0]])).alias("days"))


def price_trend(points: Column, days: Column, as_of: Column) -> dict[str, Column]:
    """Whole percent from the first to the last known point, the number of falls between neighbours, and the days since the
    first. Points of zero are unknown; null below two points and where the last equals the first."""
    known = F.filter(F.arrays_zip(points.alias("p"), days.alias("d")), lambda x: F.coalesce(x["p"] != 0, F.lit(False)))
    values = F.transform(known, lambda x: x["p"])
    first, last = F.get(values, F.lit(0)), F.get(values, F.size(values) - 1)
    falls = F.size(F.filter(F.transform(values, lambda x, i: F.coalesce(x < F.get(values, i - 1), F.lit(False))), lambda x: x))
    tells = (F.size(known) >= 2) & (first != last)
    return {
        "change_pct": F.when(tells, F.bround(100 * (last - first) / first).cast("int")),
        "falls": F.when(tells, falls),
        "span_days": F.when(tells, F.date_diff(as_of, F.transform(known, lambda x: x["d"])[0])),
    }


def annul_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, disputed): the only value that rows give a key, or null and a dispute if they differ."""
    one = F.count_distinct(value) == 1
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.when(one, F.min(value)).alias("value"), (~one).alias("disputed"))


def novel(df: DataFrame, state: DataFrame, key: str, url: str) -> DataFrame:
    """Rows whose key isn't in the state and whose url isn't a single state row's."""
    return df.join(state.select(key), key, "left_anti").join(unique_by(state, [url]).select(url), url, "left_anti")


def reusable(cache: DataFrame, as_of: Column, retry_days: int = 30, keep_days: int = 180) -> DataFrame:
    """Cache rows that still hold: recently looked at, and not a failure that is due for another try."""
    fresh = F.col("looked_at") >= F.date_sub(as_of, keep_days)
    return cache.where(fresh & (F.col("failed_at").isNull() | (F.col("failed_at") > F.date_sub(as_of, retry_days))))
