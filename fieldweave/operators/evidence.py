"""Evidence of a record: ordered text, best regions, votes of readings, and consensus of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_text(rows: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Texts of a record in order, joined by line breaks, and their total length."""
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias("text"), F.sum(F.length(text)).cast("long").alias("n_chars"))


def top_k(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def votes(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """(key, value): how often and when first a value was read; counted before the shuffle."""
    return rows.groupBy(key, value).agg(F.count("*").alias("votes"), F.min(pos).alias("first_pos"))


def consensus(rows: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """The most frequent value (first seen among equals), the number of repeats, and the share of agreeing pairs."""
    by_value = votes(rows, key, value, pos)
    n, pairs = F.sum("votes"), F.sum(F.col("votes") * (F.col("votes") - 1))
    best = F.min_by(value, F.struct(-F.col("votes"), F.col("first_pos"))).alias("consensus")
    agreement = F.when(n > 1, F.round(pairs / (n * (n - 1)), 6)).otherwise(1.0)
    return by_value.groupBy(key).agg(best, n.cast("long").alias("repeats"), agreement.alias("agreement"))


def ranked_candidates(rows: DataFrame, record: str, key: Column, value: str, source: str, pos: str) -> DataFrame:
    """Readings of a record grouped by key: votes, sources, the shortest value, score 10 * votes + sources, and the rank."""
    shortest = F.min_by(value, F.struct(F.length(value), F.col(pos))).alias("value")
    found = rows.select(record, key.alias("key"), value, source, pos).filter("key <> ''").groupBy(record, "key")
    found = found.agg(F.count("*").alias("votes"), F.count_distinct(source).alias("sources"), shortest).withColumn("score", F.col("votes") * 10 + F.col("sources"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(record).orderBy(F.desc("score"), "key")))
