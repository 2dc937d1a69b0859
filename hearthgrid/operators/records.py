"""Records as JSON lines that old and new versions read: unknown keys fall away, computed ones are made again, the rest stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def to_lines(rows: DataFrame, computed: dict[str, Column] | None = None, extras: str | None = "extras") -> DataFrame:
    """One column ``value``: each row as a JSON object with ``computed`` added, for readers that don't compute.

    Columns of type variant are written as the JSON they hold. Keys of a row that are null are left out, so a reader of an older version
    gives its own default.
    """
    columns = [c for c in rows.columns if c not in (computed or {})]
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in columns], *[v.alias(k) for k, v in (computed or {}).items()])).alias("value"))


def from_lines(lines: DataFrame, schema: StructType, computed: dict[str, Column] | None = None, defaults: dict[str, object] | None = None, value: str = "value") -> DataFrame:
    """Rows of ``schema`` from JSON lines of any version. Keys that the schema hasn't are dropped, and so are stored values of
    ``computed``, which are made of the other columns; a missing key has its default. A column of type variant takes whatever JSON stands
    there, so nested extras that nobody has a type for survive.

    Defined results: a line that isn't an object gives no row; a value of another type gives null (or its default) and leaves the
    other fields; an empty table gives an empty result.
    """
    kept = StructType([f for f in schema.fields if f.name not in (computed or {})])
    parsed = lines.select(F.from_json(F.col(value), kept).alias("_r"), F.col(value).alias("_line")).where(F.startswith(F.ltrim("_line"), F.lit("{")) & F.try_parse_json("_line").isNotNull())
    given = defaults or {}
    named = parsed.select(*[(F.coalesce(F.col(f"_r.`{f.name}`"), F.lit(given[f.name]).cast(f.dataType)) if f.name in given else F.col(f"_r.`{f.name}`")).alias(f.name) for f in kept.fields])
    return named.withColumns(computed) if computed else named
