"""Results by key that survive interrupted and overlapping runs: each run writes a folder of its own, which counts once it is whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Work = Callable[[DataFrame], DataFrame]


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of runs that ended: Spark writes _SUCCESS last."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.isDirectory()]
    return sorted(str(p) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def kept(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """One row a key from all whole runs; where two overlapping runs did the same key, the row of the first by name. None before the first run."""
    folders = _folders(spark, path)
    if not folders:
        return None
    rows = spark.read.parquet(*folders)
    columns = [c for c in rows.columns if c not in keys]
    named = rows.withColumn("_run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return named.groupBy(*keys).agg(F.min_by(F.struct(*columns), "_run").alias("row")).select(*keys, "row.*")


def resumed(spark: SparkSession, asked: DataFrame, path: str, keys: list[str], work: Work) -> DataFrame:
    """What `work` gives for the asked rows: those whose keys earlier runs hold are not done again.

    A run that fails leaves a folder without _SUCCESS, which nothing reads. Keys are compared by equality; rows with a null key are done each time.
    """
    before = kept(spark, path, keys)
    todo = asked if before is None else asked.join(before.select(*keys), keys, "left_anti")
    work(todo).write.parquet(f"{path}/run-{uuid.uuid4().hex}")
    return kept(spark, path, keys)
