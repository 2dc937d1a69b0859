"""Entity resolution: group collapse, address groups with units, text copies, merging into a principal, twins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import fold


def collapse(df: DataFrame, group: str, rank: list[Column], fill: list[str], source_tag: Column | None = None) -> DataFrame:
    """One row for each group: the best by ``rank`` (ties must be broken there), with its unknown ``fill`` columns taken from
    the other rows in rank order. Columns that aren't filled, such as prices, stay the winner's.

    ``also_in`` lists the other rows' distinct tags in order. One shuffle on the group serves all of it.
    """
    tag = F.lit(None).cast("string") if source_tag is None else source_tag
    order = Window.partitionBy(group).orderBy(*rank)
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = {c: F.first(_known(df, c), ignorenulls=True).over(all_rows) for c in fill}
    out = df.withColumn("_tag", tag).withColumn("_rank", F.row_number().over(order))
    out = out.withColumns(known | {"_tags": F.collect_set("_tag").over(all_rows), "copies": F.count("*").over(all_rows)})
    also = F.array_sort(F.array_except("_tags", F.array("_tag")))
    return out.where("_rank = 1").withColumn("also_in", F.array_join(also, ",")).drop("_tag", "_tags", "_rank")


def _known(df: DataFrame, c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c)) if df.schema[c].dataType.typeName() == "string" else F.col(c)


def richness(columns: list[str]) -> Column:
    """Number of columns with a value; zero, false and the empty text count as none, a repeated column counts twice."""
    total = F.lit(0)
    for c in columns:
        total = total + F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0", "false"), 0).otherwise(1)
    return total


def unit_groups(df: DataFrame, group: str, unit: str, price: str) -> DataFrame:
    """Adds ``entity``: the address group, split by unit where it holds more than one.

    A row without a unit joins the only unit that asks its exact price; if there's none or more than one, it stays alone by
    its ``_ord``.
    """
    units = df.where(F.col(unit).isNotNull() & F.col(group).isNotNull())
    per_group = units.groupBy(group).agg(F.count_distinct(unit).alias("_n"))
    by_price = units.where(F.col(price).isNotNull()).groupBy(group, price).agg(F.count_distinct(unit).alias("_m"), F.min(unit).alias("_u"))
    out = df.join(per_group, group, "left").join(by_price.where("_m = 1").drop("_m"), [group, price], "left")
    many = F.coalesce(F.col("_n"), F.lit(0)) > 1
    entity = (
        F.when(F.col(group).isNull(), F.concat(F.lit("row|"), F.col("_ord").cast("string")))
        .when(~many, F.col(group))
        .when(F.coalesce(F.col(unit), F.col("_u")).isNotNull(), F.concat_ws("|", group, F.coalesce(F.col(unit), F.col("_u"))))
        .otherwise(F.concat(F.lit("row|"), F.col("_ord").cast("string")))
    )
    return out.withColumn("entity", entity).drop("_n", "_u")


def text_copies(df: DataFrame, source: str, text: str, order: str, least: int = 80) -> DataFrame:
    """The first row of each source and folded text; texts below ``least`` characters are never copies."""
    folded = fold(F.coalesce(F.col(text), F.lit("")))
    keyed = df.withColumn("_h", F.when(F.length(folded) >= least, F.sha1(folded)))
    # rows that can't be copies are dealt by their own order, so they make no large group
    spread = Window.partitionBy(source, F.coalesce("_h", F.concat(F.lit("row|"), F.col(order).cast("string")))).orderBy(order)
    return keyed.withColumn("_k", F.row_number().over(spread)).where("_h is null or _k = 1").drop("_h", "_k")


def principal_merges(df: DataFrame, blocks: list[str], key: str, order: list[str], rank: list[str], near: Callable[[dict, dict], bool]) -> DataFrame:
    """(blocks, loser, merged_into, was_head, nth): in a block, rows in order meet the block's one principal; where they are near,
    the one that ranks higher (the principal on a tie) is the principal from there on and takes the other in.

    ``order`` breaks all ties; ``rank``: columns compared as numbers, nulls lowest; ``near``: test of two rows as dicts. Blocks
    are streamed in sorted partitions and only the principal is held, so a block of any size fits. nth rises within a block.
    """
    columns = list(dict.fromkeys([*blocks, key, *rank, *[c for c in df.columns if c in near.columns]]))
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in blocks], *[f"{n} {df.schema[key].dataType.simpleString()}" for n in ("loser", "merged_into")], "was_head boolean, nth long"])
    kinds = [*[to_arrow_type(df.schema[c].dataType) for c in blocks], *[to_arrow_type(df.schema[key].dataType)] * 2, pa.bool_(), pa.int64()]
    names = [*blocks, "loser", "merged_into", "was_head", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, head, nth = None, None, 0
        for b in batches:
            out = []
            for row in b.to_pylist():
                own = tuple(row[c] for c in blocks)
                if own != block:
                    block, head = own, row
                elif near(head, row):
                    higher = [float("-inf") if row[c] is None else row[c] for c in rank] > [float("-inf") if head[c] is None else head[c] for c in rank]
                    winner, loser = (row, head) if higher else (head, row)
                    nth += 1
                    out.append((*own, loser[key], winner[key], higher, nth))
                    head = winner
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    known = df.where(" and ".join(f"`{c}` is not null" for c in blocks))
    return known.repartition(*blocks).sortWithinPartitions(*blocks, *order).select(*columns).mapInArrow(run, schema)


def merge_into_principal(df: DataFrame, blocks: list[str], key: str, order: list[str], rank: list[str], near: Callable[[dict, dict], bool]) -> DataFrame:
    """(key, merged_into): what each row was merged into by ``principal_merges``, null where it stays."""
    merges = principal_merges(df, blocks, key, order, rank, near).select(F.col("loser").alias(key), "merged_into")
    return df.select(key).join(merges, key, "left")


def within(lat: str, lon: str, km: float, most: dict[str, float]) -> Callable[[dict, dict], bool]:
    """Test for ``merge_into_principal``: at most ``km`` apart, and no known value of ``most`` differs by more."""

    def near(a: dict, b: dict) -> bool:
        if None in (a[lat], a[lon], b[lat], b[lon]):
            return False
        la, lb = math.radians(a[lat]), math.radians(b[lat])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[lon] - a[lon]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h))) <= km and not any(a[c] is not None and b[c] is not None and abs(a[c] - b[c]) > x for c, x in most.items())

    near.columns = {lat, lon, *most}
    return near


def same_offer(area: str, price: str, most: dict[str, float] | None = None) -> Callable[[dict, dict], bool]:
    """Test for ``merge_into_principal`` on broker codes: areas within one unit or prices within one percent, and no known
    value of ``most`` that differs by more. An area or price of zero is unknown."""

    def near(a: dict, b: dict) -> bool:
        areas = bool(a[area] and b[area]) and abs(a[area] - b[area]) <= 1
        prices = bool(a[price] and b[price]) and abs(a[price] - b[price]) <= 0.01 * max(a[price], b[price])
        return (areas or prices) and not any(a[c] is not None and b[c] is not None and abs(a[c] - b[c]) > x for c, x in (most or {}).items())

    near.columns = {area, price, *(most or {})}
    return near


def twins(df: DataFrame, signature: list[str], key: str) -> DataFrame:
    """Rows that share their known signature with others: ``twin_of``, the smallest key of the class, and the number of others.
    Such rows are told, never merged; a class is never collected."""
    known = df.where(" and ".join(f"{c} is not null" for c in signature))
    groups = known.groupBy(*signature).agg(F.min(key).alias("twin_of"), (F.count("*") - 1).alias("n_twins")).where("n_twins > 0")
    return df.join(groups, signature)
