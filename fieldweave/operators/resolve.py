"""Resolution of field values against the other readings of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Other names of countries.
COUNTRIES = {
    "uk": "United Kingdom",
    "u.k.": "United Kingdom",
    "england": "United Kingdom",
    "scotland": "United Kingdom",
    "usa": "United States",
    "u.s.a.": "United States",
    "us": "United States",
    "united states of america": "United States",
}


def country(value: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))
    trimmed = F.trim(F.coalesce(value, F.lit("")))
    return F.coalesce(F.element_at(names, F.lower(trimmed)), trimmed)


def binomial(name: Column) -> Column:
    """The leading genus and species of a name, or the whole name."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))
    two = F.regexp_extract(squeezed, r"^[A-Z][a-zA-Z\-]+ [a-z][a-zA-Z\-]+", 0)
    return F.when(two == "", squeezed).otherwise(two)


def best_candidate(ranked: DataFrame, record: str, limit: int = 5) -> DataFrame:
    """The first of the ranked candidates of a record, up to `limit` strong others, and whether there are any.

    Strong: a score of 25 at least, and at most 35 below the best. `ranked` has key, value, score and rank.
    """
    top = F.max("score").over(Window.partitionBy(record))
    strong = ranked.withColumn("strong", (F.col("rank") > 1) & (F.col("score") >= F.greatest(F.lit(25), top - 35)))
    others = F.array_sort(F.collect_list(F.when(F.col("strong"), F.struct("rank", "value"))))
    found = strong.groupBy(record).agg(F.min_by("value", "rank").alias("value"), others.alias("others"))
    values = F.array_join(F.transform(F.slice("others", 1, limit), lambda x: x["value"]), ";").alias("alternatives")
    return found.select(record, "value", values, (F.size("others") > 0).alias("review"))


def safe_extension(originals: DataFrame, readings: DataFrame, record: str, original: str, reading: str, pos: str, longest: int = 4) -> DataFrame:
    """Values completed by the only reading that continues them by up to `longest` characters, and what was done.

    Readings of one key count once, and the first stands for them. One equi-join by record; groups hold distinct keys.
    """
    mine = originals.select(record, F.trim(F.coalesce(original, F.lit(""))).alias("original")).withColumn("own", T.identifier_key(F.col("original")))
    other = readings.select(record, T.identifier_key(F.col(reading)).alias("key"), F.col(reading).alias("reading"), pos).filter(F.col("key").rlike("^[A-Z]{1,4}[0-9]{6,14}$"))
    other = other.groupBy(record, "key").agg(F.min_by("reading", pos).alias("reading"))
    longer = F.length("key") - F.length("own")
    fits = F.col("own").rlike("^[A-Z]{1,4}[0-9]{4,14}$") & longer.between(1, longest) & F.col("key").startswith(F.col("own"))
    found = mine.join(other, record, "left").groupBy(record, "original", "own").agg(F.count_if(fits).alias("n"), F.first(F.when(fits, F.col("reading")), ignorenulls=True).alias("only"))
    done = (
        F.when(F.col("own") == "", "not_provided")
        .when(~F.col("own").rlike("^[A-Z]{1,4}[0-9]{4,14}$"), "original_not_structured")
        .when(F.col("n") == 1, "strict_extension_applied")
        .when(F.col("n") > 1, "ambiguous_extension")
        .otherwise("no_safe_extension")
    )
    return found.select(record, F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("original")).alias("value"), done.alias("status"))


def diverse(rows: DataFrame, record: str, role: str, utility: Column, key: str, quotas: dict[str, int], total: int) -> DataFrame:
    """Up to `total` rows of a record: the best of each role in the order of `quotas`, then the next best within the quotas."""
    within = F.row_number().over(Window.partitionBy(record, role).orderBy(utility.desc(), key))
    quota = F.coalesce(*(F.when(F.col(role) == r, n) for r, n in quotas.items()), F.lit(0))
    turn = F.coalesce(*(F.when((F.col(role) == r) & (F.col("in_role") == 1), i) for i, r in enumerate(quotas)), F.lit(len(quotas)))
    held = rows.withColumn("in_role", within).filter(F.col("in_role") <= quota)
    place = F.row_number().over(Window.partitionBy(record).orderBy(turn, utility.desc(), key))
    return held.withColumn("place", place).filter(F.col("place") <= total).drop("in_role")
