"""Passing tables: what a long plan writes between its steps, so that each step is planned and recovered by itself."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors see; a local session without one gets its own."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"spark-shared-{os.getpid()}"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


class Passing:
    """Tables of one run. ``held`` writes one and reads it back, ``release`` deletes those that aren't to be kept."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def held(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{self.label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def release(self, *keep: DataFrame) -> None:
        for path in [p for p, df in self.paths.items() if all(df is not k for k in keep)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            del self.paths[path]
