"""Summaries of records: macro and pooled means, pivots, dense counts, mean vectors, bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..packaging import ship


def macro_micro(rows: DataFrame, group: str, field: str, value: Column) -> DataFrame:
    """The mean of the field means, the mean of all rows, and the mean of the rows above zero, by group."""
    filled = F.when(value > 0, value)
    fields = rows.groupBy(group, field).agg(F.avg(value).alias("mean"), F.sum(value).alias("s"), F.count(value).alias("n"), F.sum(filled).alias("fs"), F.count(filled).alias("fn"))
    macro, micro, some = F.avg("mean"), F.try_divide(F.sum("s"), F.sum("n")), F.try_divide(F.sum("fs"), F.sum("fn"))
    return fields.groupBy(group).agg(F.round(macro, 6).alias("macro"), F.round(micro, 6).alias("micro"), F.round(some, 6).alias("filled"))


def pivot_means(rows: DataFrame, group: str, field: str, values: list[str], value: Column) -> DataFrame:
    """One column of means a field; the fields are named, so no pass is spent on finding them."""
    return rows.groupBy(group).pivot(field, values).agg(F.round(F.avg(value), 6))


def dense_counts(spine: DataFrame, rows: DataFrame, key: str, value: Column) -> DataFrame:
    """Rows and their sum for every key of the spine, zero where there are none; aggregated before the join."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    filled = spine.select(key).distinct().join(found, key, "left")
    return filled.select(key, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0)), 2).cast("double").alias("total"))


def in_all(rows: DataFrame, key: str, part: str, parts: list[str]) -> DataFrame:
    """Keys that stand in every one of the parts."""
    return rows.filter(F.col(part).isin(*parts)).groupBy(key).agg(F.count_distinct(part).alias("parts")).filter(F.col("parts") == len(set(parts))).select(key)


def last_of(rows: DataFrame, keys: list[str], order: list[str], *columns: str) -> DataFrame:
    """The last row of each key, by a mergeable aggregate rather than a sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last")).select(*keys, "last.*")


def distinct_lines(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """The different lines of a record in the order in which they were first seen, joined by line breaks."""
    lines = rows.select(key, pos, F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).filter("trim(line) <> ''")
    first = lines.groupBy(key, "line").agg(F.min(F.struct(pos, "at")).alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "line")))
    return first.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n_lines"))


def mean_vectors(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, value): the mean vector of a group at length one; null vectors are left out."""
    means = rows.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("mean"))
    norms = means.groupBy(group).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    scaled = F.when(F.col("norm") > 0, F.col("mean") / F.col("norm")).otherwise(F.col("mean"))
    return means.join(norms, group).select(group, "dim", F.round(scaled, 6).alias("value"))


#: Chances of up to 0, 1, 2, ... draws of one record where records are drawn with replacement (Poisson, mean one).
DRAWS = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]


def times_drawn(records: list[str], n: int) -> np.ndarray:
    """How often each of n resamples draws each record (records x n), by digests of 16 bytes that give four draws each."""
    ends = [f"|{i}".encode() for i in range(-(-n // 4))]
    own = b"".join([hashlib.md5(r + e, usedforsecurity=False).digest() for r in (x.encode() for x in records) for e in ends])
    chance = np.frombuffer(own, ">u4").astype(np.uint32).reshape(len(records), -1)[:, :n]
    times = np.zeros(chance.shape, np.int8)
    for least in DRAWS:
        times += chance >= np.uint32(math.ceil(least * 2.0**32))
    return times


def bootstrap(rows: DataFrame, group: str, record: str, value: str, n: int = 500, most: int = 1024) -> DataFrame:
    """Mean over records with the 2.5 and 97.5 percentiles of n resamples, by group.

    How often a record is drawn follows from its digest, so each task keeps n sums a group. A record's groups lie next to
    each other, so that its digests are worked out once; `most` rows at a time are multiplied out.
    """
    ship(rows.sparkSession)
    records = rows.repartition(F.col(record)).groupBy(group, record).agg(F.avg(value).alias("mean")).filter("mean is not null")

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a task: what each group adds to each draw."""
        total: dict[object, np.ndarray] = {}
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                own = pa.array(part.column(1).fill_null("None")).dictionary_encode()
                times = times_drawn(own.dictionary.to_pylist(), n)
                place, mean, names = own.indices.to_numpy(), part.column(2).to_numpy(), np.array(part.column(0).to_pylist(), object)
                for name in set(names):
                    held = np.array([x == name for x in names])
                    drawn = times[place[held]].astype(np.float64)
                    total.setdefault(name, np.zeros((2, n)))[:] += (mean[held] @ drawn, drawn.sum(0))
        for name, (sums_, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, kind), pa.array(np.arange(n)), pa.array(sums_), pa.array(counts)], ["name", "draw", "s", "c"])

    field = records.schema[group].dataType
    kind = to_arrow_type(field)
    drawn = records.sortWithinPartitions(record).select(group, F.col(record).cast("string"), "mean").mapInArrow(resample, f"name {field.simpleString()}, draw long, s double, c double")
    sums = drawn.groupBy(F.col("name").alias(group), "draw").agg((F.sum("s") / F.sum("c")).alias("resampled"))
    ends = sums.groupBy(group).agg(*(F.round(F.percentile("resampled", F.lit(p)), 6).alias(name) for p, name in ((0.025, "low"), (0.975, "high"))))
    means = records.groupBy(group).agg(F.round(F.avg("mean"), 6).alias("mean"), F.count("*").alias("n_records"))
    return means.join(ends, group)
