"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, secret removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it's written as Parquet and read again before the next, so
every stage starts from a table that survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthgrid.llm import decontamination, packing, quality_rules, secret_scan, simhash
from hearthgrid.llm.common import discard_but, materialize, table, written

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontamination.stage),
    ("secret_scan", secret_scan.stage),
    ("best_fit_packing", packing.stage),
]

#: Fingerprints, latent retrieval and tokens aren't SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard_but(spark, *before, docs.scratch_path)  # the table of the stage before, and what this one left
    return docs
