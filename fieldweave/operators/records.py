"""Records with their parts: manifests, packets, candidates, stability over repeats, deltas between methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as R
from ..functions import text as T


def manifest(asked: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Every asked key with what the manifest holds for it: `held` has key, stored_sha and actual_sha; the reason is blank if it can be used."""
    joined = asked.select(key).join(held, key, "left")
    reason = F.when(F.col("actual_sha").isNull(), "missing_from_manifest").when(F.coalesce("stored_sha", F.lit("")) != F.col("actual_sha"), "sha256_mismatch").otherwise("")
    return joined.select(key, reason.alias("excluded_reason")).withColumn("paired_eligible", F.col("excluded_reason") == "")


def running_index(rows: DataFrame, record: str, *order: str) -> DataFrame:
    return rows.withColumn("index", F.row_number().over(Window.partitionBy(record).orderBy(*order)))


def reading_order(rows: DataFrame, record: str, k: int, confidence: str, y: str, x: str, key: str) -> DataFrame:
    """The k surest regions of a record, numbered from top to bottom and left to right."""
    surest = F.row_number().over(Window.partitionBy(record).orderBy(F.desc(confidence), key))
    place = F.row_number().over(Window.partitionBy(record).orderBy(y, x, key))
    return rows.withColumn("_k", surest).filter(F.col("_k") <= k).drop("_k").withColumn("place", place)


def packets(components: DataFrame, readings: DataFrame, record: str, region: str, pos: str) -> DataFrame:
    """One row a record: its components in order, each with its readings that hold text, and how many have none."""
    texts = readings.filter(T.clean(F.col("text")) != "").groupBy(record, region).agg(F.array_sort(F.collect_list(F.struct(pos, "text"))).alias("texts"))
    joined = components.join(texts, [record, region], "left").withColumn("texts", F.transform(F.coalesce("texts", F.array().cast(texts.schema["texts"].dataType)), lambda x: x["text"]))
    packet = F.array_sort(F.collect_list(F.struct(region, "kind", "texts"))).alias("packet")
    return joined.groupBy(record).agg(packet, F.count_if(F.size("texts") == 0).alias("empty"))


def packet_text(packet: Column) -> Column:
    """The packet as prompt text: a header a component, then its readings."""
    return F.array_join(F.transform(packet, lambda c: F.concat(F.lit("["), c["kind"], F.lit("]\n"), F.array_join(c["texts"], "\n"))), "\n\n")


def candidates(readings: DataFrame, record: str, text: str, source: str, limit: int = 8) -> DataFrame:
    """Ranked identifiers among the lines of readings: 10 a vote and the score of the shape; shortest value first seen; joined sources."""
    lines = readings.select(record, source, F.explode(R.identifier_lines(F.col(text))).alias("value")).withColumn("key", T.identifier_key(F.col("value")))
    grouped = lines.groupBy(record, "key").agg(F.count("*").alias("votes"), F.array_join(F.array_sort(F.collect_set(source)), ";").alias("sources"), F.min_by("value", F.struct(F.length("value"), "value")).alias("value"))
    scored = grouped.withColumn("score", F.col("votes") * 10 + R.pattern_score(F.col("key")))
    rank = F.row_number().over(Window.partitionBy(record).orderBy(F.desc("score"), F.desc("votes"), "key"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def merged_candidates(parts: DataFrame, record: str) -> DataFrame:
    """Candidates of several passes as one a key: most votes, best score, all sources, value of the highest priority (then least)."""
    return parts.groupBy(record, "key").agg(F.max("votes").alias("votes"), F.max("score").alias("score"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("sources", ";"))))), ";").alias("sources"), F.min_by("value", F.struct(-F.col("priority"), "value")).alias("value"))


def contained(values: DataFrame, texts: DataFrame, record: str, value: str, text: str) -> DataFrame:
    """Records whose normal value stands in one of their texts: an equi-join by record, then a test of containment."""
    keyed = values.select(record, T.identifier_key(F.col(value)).alias("key")).filter("key <> ''")
    held = texts.select(record, T.identifier_key(F.col(text)).alias("body"))
    return keyed.join(held, record).groupBy(record, "key").agg(F.max(F.contains("body", "key")).alias("supported"))


def stability(repeats: DataFrame, record: str, field: str, value: str, repeat: str, least: float = 0.75) -> DataFrame:
    """Over repeats of a record's field: the commonest value (first seen of ties), agreement of pairs, action and priority.

    Columns direct and review are 0 or 1, confidence may be null. Unanimous, direct, unreviewed and sure values are accepted.
    """
    votes = repeats.groupBy(record, field, value).agg(F.count("*").alias("c"), F.min(repeat).alias("first"), F.sum("direct").alias("direct"), F.sum("review").alias("review"), F.min("confidence").alias("sure"), F.count("confidence").alias("known"))
    best = F.max_by(F.struct(value, "c"), F.struct("c", -F.col("first")))
    out = votes.groupBy(record, field).agg(best.alias("best"), F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"), F.sum("direct").alias("direct"), F.sum("review").alias("review"), F.min("sure").alias("sure"), F.sum("known").alias("known"))
    filled, same = F.coalesce(F.col(f"best.{value}"), F.lit("")) != "", F.col("best.c") == F.col("n")
    accept = filled & same & (F.col("direct") == F.col("n")) & (F.col("review") == 0) & (F.col("known") == F.col("n")) & (F.col("sure") >= least)
    action = F.when(accept, "auto_accept").when(~filled & same, "empty_consensus").otherwise("human_review")
    urgent = (F.col("best.c") == 1) | (F.col("direct") == 0) | (F.col(field) == "catalogNumber")
    agreement = F.when(F.col("n") > 1, F.col("pairs") / (F.col("n") * (F.col("n") - 1))).otherwise(1.0)
    return out.select(record, field, F.col(f"best.{value}").alias("consensus"), F.round(agreement, 6).alias("agreement"), action.alias("action"), F.when(action != "human_review", "").when(urgent, "high").otherwise("medium").alias("priority"))


def verdicts(deltas: DataFrame, delta: str) -> Column:
    """helped, hurt or same, by the sign of a delta."""
    return F.when(F.col(delta) > 0, "helped").when(F.col(delta) < 0, "hurt").otherwise("same")
