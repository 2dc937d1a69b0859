"""Filling unknown fields of a page's listings from another reading of the same page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _filled(df: DataFrame, side: str, fields: list[str], allowed: Column) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.when(allowed, F.col(side)[c])) for c in fields})


def fill_by_key(rows: DataFrame, cards: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Unknown fields from the only card with the row's keys; keys that several cards share fill nothing."""
    side = cards.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*fields)).alias("_c")).where("_n = 1")
    return _filled(rows.join(side, keys, "left"), "_c", fields, F.lit(True)).select(*rows.columns)


def fill_by_title(rows: DataFrame, cards: DataFrame, page: str, key: str, title: str, text: str, fields: list[str], length: int = 80) -> DataFrame:
    """Unknown fields from the card of the page whose text alone holds the start of the row's title.

    Pairs are made within a page only, and a page holds a bounded number of listings.
    """
    head = F.left(F.col(title), F.lit(length))
    left = rows.where(F.length(F.trim(F.coalesce(F.col(title), F.lit("")))) > 0).select(page, key, head.alias("_t"))
    side = cards.select(page, F.col(text).alias("_x"), F.struct(*fields).alias("_c"))
    found = left.join(side, page).where(F.contains("_x", F.col("_t"))).groupBy(page, key).agg(F.count("*").alias("_n"), F.first("_c").alias("_c")).where("_n = 1")
    return _filled(rows.join(found.drop("_n"), [page, key], "left"), "_c", fields, F.lit(True)).select(*rows.columns)


def fill_by_position(rows: DataFrame, cards: DataFrame, page: str, pos: str, agree: list[str], fields: list[str], least: int = 3, same_count: bool = True) -> DataFrame:
    """Unknown fields from the card in the same place, for pages where that is safe.

    A page is safe if both readings have as many entries (unless ``same_count`` is off), no known value of the ``agree`` columns
    differs in any place, and at least ``least`` places agree on a known value.
    """
    side = cards.select(page, pos, F.struct(*dict.fromkeys([*agree, *fields])).alias("_c"))
    both = rows.withColumn("_l", F.lit(1)).join(side.withColumn("_r", F.lit(1)), [page, pos], "full")
    w = Window.partitionBy(page)
    clash, anchor = F.lit(False), F.lit(False)
    for c in agree:
        clash = clash | F.coalesce(F.col(c) != F.col("_c")[c], F.lit(False))
        anchor = anchor | F.coalesce(F.col(c) == F.col("_c")[c], F.lit(False))
    both = both.withColumns({"_clash": F.count_if(clash).over(w), "_anchor": F.count_if(anchor).over(w), "_nl": F.count("_l").over(w), "_nr": F.count("_r").over(w)})
    safe = (F.col("_clash") == 0) & (F.col("_anchor") >= least)
    if same_count:
        safe = safe & (F.col("_nl") == F.col("_nr"))
    return _filled(both.where("_l = 1"), "_c", fields, safe).select(*rows.columns)
