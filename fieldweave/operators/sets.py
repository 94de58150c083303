"""Sets of keys and rows over several frames: unions that keep the first, intersections, differences, outer counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(frames: list[DataFrame], *keys: str) -> DataFrame:
    """All rows of the frames, of each key those of the first frame that has it (of several there, the least row)."""
    marked = [f.select(*keys, F.struct(F.lit(i).alias("_frame"), F.struct(*[c for c in f.columns if c not in keys]).alias("_row")).alias("_at")) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, marked).groupBy(*keys).agg(F.min("_at").alias("_at")).select(*keys, "_at._row.*", F.col("_at._frame").alias("frame"))


def in_all(frames: list[DataFrame], key: str, content: str | None = None) -> DataFrame:
    """Keys that every frame has; with `content`, only those for which all frames agree on one non-blank content."""
    parts = [f.select(key, F.lit(i).alias("_frame"), (F.col(content) if content else F.lit("same")).alias("_content")) for i, f in enumerate(frames)]
    found = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.count_distinct("_frame").alias("n"), F.min("_content").alias("lo"), F.max("_content").alias("hi"), F.count_if(F.coalesce("_content", F.lit("")) == "").alias("blank"))
    return found.filter((F.col("n") == len(frames)) & (F.col("lo") == F.col("hi")) & (F.col("blank") == 0)).select(key)


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def same_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many keys only the left has, only the right has, both have, and whether the sets are equal."""
    side = lambda f, n: f.select(key).distinct().withColumn("side", F.lit(n))
    both = side(left, 1).unionByName(side(right, 2)).groupBy(key).agg(F.sum("side").alias("side"))
    count = lambda n: F.count_if(F.col("side") == n)
    return both.agg(count(1).alias("only_left"), count(2).alias("only_right"), count(3).alias("n_both"), (count(1) + count(2) == 0).alias("equal"))


def outer_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows by key in either frame, 0 where one has none."""
    one = lambda f, n: f.select(key, F.lit(int(n == 0)).alias("left"), F.lit(int(n == 1)).alias("right"))
    return one(left, 0).unionByName(one(right, 1)).groupBy(key).agg(F.sum("left").cast("long").alias("n_left"), F.sum("right").cast("long").alias("n_right"))


def reference_corpus(guides: DataFrame, examples: DataFrame, authority: DataFrame, key: str, shown: list[str]) -> DataFrame:
    """(source, key, text): guide texts, examples as `name: value` parts, and authority texts, all rows of each."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in shown]
    none = F.lit("").alias("key")
    return (
        guides.select(F.lit("field_guide").alias("source"), none, "text")
        .unionByName(examples.select(F.lit("demo_example").alias("source"), F.col(key).cast("string").alias("key"), F.concat_ws(" | ", *parts).alias("text")))
        .unionByName(authority.select(F.lit("authority_cache").alias("source"), none, "text"))
    )


def leaked(references: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """Non-blank keys, outer white space aside, that references and evaluation share."""
    of = lambda f: f.select(F.regexp_replace(F.col(key).cast("string"), r"^\s+|\s+$", "").alias(key)).filter(F.coalesce(F.col(key), F.lit("")) != "").distinct()
    return of(references).join(of(evaluation), key, "left_semi")


def assert_no_leak(references: DataFrame, evaluation: DataFrame, key: str) -> DataFrame:
    """The references, or an error that names up to ten keys that evaluation has too."""
    found = [r[0] for r in leaked(references, evaluation, key).orderBy(key).limit(10).collect()]
    if found:
        raise ValueError(f"references hold evaluation records: {found}")
    return references
