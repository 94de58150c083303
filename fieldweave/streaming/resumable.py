"""A stream of records to results by key, once each, through stops and restarts.

Every micro-batch writes a folder named after its number and writes it anew if Spark repeats the batch, so a batch that was
cut off leaves nothing behind. Keys that earlier batches hold are left out, so a record that comes again isn't done again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_NAME = "batch={:019d}"


def _done(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    last = _NAME.format(before)
    names = [s.getPath() for s in files.listStatus(at) if s.getPath().getName() < last]
    whole = [str(p) for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return spark.read.parquet(*whole) if whole else None


def extract(records: DataFrame, path: str, checkpoint: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Starts the stream over what is there now; `work` gives rows that keep the keys. Await the query; start it again after a failure."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        done = _done(spark, path, number)
        if done is not None:
            fresh = fresh.join(done.select(*keys).distinct(), keys, "left_anti")
        work(fresh).write.mode("overwrite").parquet(f"{path}/{_NAME.format(number)}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, path: str) -> DataFrame:
    """All rows of whole batches."""
    return _done(spark, path, (1 << 62)).drop("batch")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, for sources that correct themselves."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("row")).select(*keys, "row.*")
