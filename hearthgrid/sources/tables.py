"""Readers that tolerate missing, partial or damaged inputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one of the schema where there is none."""
    try:
        return spark.read.format(kind).schema(schema).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def json_lines(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Fields of the lines that are JSON objects; blank and damaged lines are passed over, other columns stay."""
    parsed = lines.withColumn("_r", F.from_json(F.col(line), f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where(F.trim(F.col(line)).startswith("{") & F.col("_r").isNotNull() & F.col("_r._bad").isNull())
    return good.select(*[c for c in lines.columns if c != line], "_r.*").drop("_bad")


def declared_charset(content: Column, header: Column | None = None) -> Column:
    """Character set of the header, else of a meta tag in the first 4096 bytes, else utf-8."""
    head = F.decode(F.substr(content, F.lit(1), F.lit(4096)), "ISO-8859-1")
    said = F.nullif(F.lower(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1)), F.lit(""))
    return F.coalesce(*([] if header is None else [F.nullif(F.lower(F.regexp_extract(header, r"(?i)charset=([A-Za-z0-9_-]+)", 1)), F.lit(""))]), said, F.lit("utf-8"))


def decode_pages(pages: DataFrame, content: str = "content", header: Column | None = None) -> DataFrame:
    """Adds ``html``, decoded as declared; an unknown name is read as utf-8."""
    name = declared_charset(F.col(content), header)
    text = F.when(name.isin("iso-8859-1", "latin1", "windows-1252"), F.decode(content, "ISO-8859-1")).when(name.isin("utf-16"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))
    return pages.withColumn("html", text)


def until_first_empty(pages: DataFrame, group: list[str], page_no: str, rows: str) -> DataFrame:
    """Pages of each url up to the first one that gave no rows, that one left out."""
    stop = pages.groupBy(*group).agg(F.min(F.when(F.coalesce(F.col(rows), F.lit(0)) == 0, F.col(page_no))).alias("_stop"))
    return pages.join(stop, group).where(F.col("_stop").isNull() | (F.col(page_no) < F.col("_stop"))).drop("_stop")


def in_catalog_order(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """Union of sources with their place in the catalog as ``src_ord``; order never depends on arrival."""
    out = None
    for i, (df, name) in enumerate(zip(parts, names, strict=True)):
        part = df.withColumns({"source": F.lit(name), "src_ord": F.lit(i)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
