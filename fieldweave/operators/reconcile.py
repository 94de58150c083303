"""Reconciled fields: which of a record's values its own texts support, and where each value comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def region_texts(readings: DataFrame, record: str, region: str, pos: str, text: str) -> DataFrame:
    """The texts of each region, in order, one a line; regions without text stay with a blank one. A region is what one task holds."""
    kept = F.filter(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), T.clean(F.col(text)).alias("text")))), lambda x: x["text"] != "")
    return readings.groupBy(record, region).agg(F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("body"))


def validated(fields: DataFrame, regions: DataFrame, record: str, region: str) -> DataFrame:
    """Fields whose evidence stands in the region they name; the others lose their value and go to review.

    `fields` has field, value, confidence, span, source, alternatives (array of strings) and review; `regions` is region_texts().
    Confidence is kept within 0 and 1, 0 where it is no number. Alternatives ask for review too.
    """
    known = regions.select(record, F.col(region).alias("source"), "body")
    tidy = fields.select(record, "field", T.clean(F.col("value")).alias("value"), F.col("confidence").try_cast("double").alias("sure"), T.clean(F.col("span")).alias("span"), T.clean(F.col("source")).alias("source"), "alternatives", F.coalesce("review", F.lit(False)).alias("review"))
    joined = tidy.join(known, [record, "source"], "left")
    held = F.col("body").isNotNull() & (F.col("span") != "") & F.contains(F.lower("body"), F.lower("span"))
    blank = (F.col("value") != "") & ~F.coalesce(held, F.lit(False))
    sure = F.when(F.isnan("sure"), 0.0).otherwise(F.least(F.greatest(F.coalesce("sure", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    unless = lambda c, other: F.when(blank, other).otherwise(c)
    others = F.filter(F.transform(F.coalesce("alternatives", F.array().cast("array<string>")), T.clean), lambda x: x != "")
    listed = unless(others, F.array().cast("array<string>"))
    return joined.select(
        record, "field", unless(F.col("value"), "").alias("value"), unless(sure, 0.0).alias("confidence"), unless(F.col("span"), "").alias("span"), unless(F.col("source"), "").alias("source"),
        listed.alias("alternatives"), blank.alias("unsupported"), (F.col("review") | blank | (F.size(others) > 0)).alias("review"),
    )


def overridden(fields: DataFrame, resolved: DataFrame, record: str, field: str) -> DataFrame:
    """The resolved value (record, value, review) takes the place of the field's own; one of another key becomes an alternative and asks for review.

    Of several values of a record the greatest counts; any of its rows may ask for review.
    """
    one = resolved.filter(T.clean(F.col("value")) != "").groupBy(record).agg(F.max("value").alias("_value"), F.bool_or("review").alias("_review"))
    better = one.withColumn("field", F.lit(field))
    joined = fields.join(better, [record, "field"], "left")
    taken = F.col("_value").isNotNull()
    differs = taken & (F.col("value") != "") & (T.identifier_key(F.col("value")) != T.identifier_key(F.col("_value")))
    alternatives = F.when(differs, F.array("value")).when(taken, F.array().cast("array<string>")).otherwise(F.col("alternatives"))
    review = F.when(taken, F.col("_review") | differs).otherwise(F.col("review"))
    return joined.withColumn("alternatives", alternatives).withColumn("review", review).withColumn("value", F.coalesce("_value", "value")).drop("_value", "_review")


def attributed(values: DataFrame, readings: DataFrame, record: str, region: str, pos: str, text: str, engine: str) -> DataFrame:
    """Each value (record, field, value, span) with the first region, by its least place, that holds its evidence, and the readings there that do.

    One equi-join by record, so a record's values and readings meet; no other pairs do.
    """
    asked = values.filter((T.clean(F.col("value")) != "") & (T.clean(F.col("span")) != ""))
    texts = readings.select(record, F.col(region).alias("source"), F.col(pos).alias("pos"), F.lower(T.clean(F.col(text))).alias("body"), F.col(engine).alias("engine"))
    hits = asked.join(texts, record).filter(F.contains("body", F.lower(T.clean(F.col("span")))))
    grouped = hits.groupBy(record, "field", "source").agg(F.min("pos").alias("first"), F.array_sort(F.collect_set(F.concat_ws(":", "source", "engine"))).alias("supporting"))
    found = grouped.groupBy(record, "field").agg(F.min(F.struct("first", "source", "supporting")).alias("at"))
    joined = values.join(found, [record, "field"], "left")
    return joined.select(*values.columns, F.coalesce("at.source", F.lit("")).alias("source"), F.coalesce("at.supporting", F.array().cast("array<string>")).alias("supporting"))
