"""Splits by a seeded digest, their summaries, and leakage between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A reproducible order: the digest of key and seed."""
    return F.sha2(F.concat(key.cast("string"), F.lit(f"|{seed}")), 256)


def assign(rows: DataFrame, key: str, seed: int, name: str = "split") -> DataFrame:
    """demo, eval or rest by the first digit of the digest."""
    digit = F.substring(draw(F.col(key), seed), 1, 1)
    return rows.withColumn(name, F.when(digit.isin("0", "1"), "demo").when(digit.isin("2", "3", "4"), "eval").otherwise("rest"))


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def leaks(rows: DataFrame, content: Column, first: str, second: str, key: str) -> DataFrame:
    """Rows of the second split whose content also stands in the first."""
    marked = rows.withColumn("content", content)
    seen = marked.filter(F.col("split") == first).select("content").distinct()
    return marked.filter(F.col("split") == second).join(seen, "content", "left_semi").select(key)


def allocation(rows: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, take): shares of n by largest remainder; among equal remainders the smaller stratum comes first."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("rows"))  # one row a stratum from here on
    total = counts.agg(F.sum("rows").alias("total"))
    shares = counts.crossJoin(F.broadcast(total)).withColumns({"take": F.expr(f"{n} * rows div total"), "left": F.expr(f"{n} * rows % total")})
    given = shares.agg(F.sum("take").alias("given"))
    order = Window.orderBy(F.desc("left"), stratum)
    ranked = shares.withColumn("rank", F.row_number().over(order)).crossJoin(F.broadcast(given))
    return ranked.select(stratum, F.least("rows", F.col("take") + (F.col("rank") <= n - F.col("given")).cast("int")).cast("long").alias("take"))


def stratified(rows: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """n rows, dealt to strata in proportion; inside a stratum those of least digest. No task keeps more than n rows of a stratum."""
    order = Window.partitionBy(stratum).orderBy(draw(F.col(key), seed), key)
    first = rows.select(key, stratum).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    shares = allocation(rows, stratum, n).withColumnRenamed(stratum, "_stratum")
    return first.join(shares, F.col(stratum).eqNullSafe(F.col("_stratum"))).filter("rank <= take").select(key, stratum)


def tertiles(rows: DataFrame, value: str, name: str = "tertile", key: str | None = None) -> DataFrame:
    """low, medium or high by the exact thirds (edges belong to the lower one); with under three values, halves. Null counts as 0.

    Where edges coincide, thirds are dealt by rank, rows of one value in the order of `key` (by default the first column).
    Ranks follow from counts by value; only rows of the two values that a cut falls into are ordered among themselves.
    """
    key = key or rows.columns[0]
    filled = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    marked = rows.withColumn("_value", filled)
    facts = marked.agg(F.percentile("_value", F.array(F.lit(1 / 3), F.lit(2 / 3), F.lit(0.5))).alias("_edge"), F.count_distinct("_value").alias("_many"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"), F.count("*").alias("_n")).first()
    (low, high, median), n = facts["_edge"] or (0.0, 0.0, 0.0), facts["_n"]
    v = F.col("_value")
    if facts["_many"] < 3:
        return marked.withColumn(name, F.when(v >= median, "high").otherwise("low")).drop("_value")
    if facts["_lo"] < low < high < facts["_hi"]:
        return marked.withColumn(name, F.when(v <= low, "low").when(v <= high, "medium").otherwise("high")).drop("_value")
    cuts = marked.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY _value)").alias(c) for p, c in ((1 / 3, "a"), (2 / 3, "b")))).first()
    below = marked.agg(*(F.count_if(v < cuts[c]).alias(c) for c in ("a", "b"))).first()
    in_cut = v.isin(cuts["a"], cuts["b"])
    place = F.row_number().over(Window.partitionBy("_value").orderBy(key))
    third = lambda rank: F.when(3 * rank <= n, "low").when(3 * rank <= 2 * n, "medium").otherwise("high")
    cut = marked.filter(in_cut).withColumn(name, third(place + F.when(v == cuts["a"], below["a"]).otherwise(below["b"])))
    clear = marked.filter(~in_cut).withColumn(name, F.when(v < cuts["a"], "low").when(v < cuts["b"], "medium").otherwise("high"))
    return clear.unionByName(cut).drop("_value")


def allocation_of_one(rows: DataFrame, stratum: str, n: int) -> DataFrame:
    """(stratum, take): proportional floors, at least one for each stratum, then the largest remainders up to n.

    The table has one row a stratum; strata are institutions or sources, which do not grow with the rows.
    """
    counts = rows.groupBy(stratum).agg(F.count("*").alias("rows"))
    everything = Window.partitionBy()
    raw = counts.withColumn("raw", float(n) * F.col("rows") / F.sum("rows").over(everything))
    given = raw.withColumn("take", F.greatest(F.floor("raw"), F.lit(1))).withColumn("up", F.row_number().over(Window.orderBy(F.desc(F.col("raw") - F.floor("raw")), F.asc_nulls_first(stratum)))).withColumn("given", F.sum("take").over(everything))
    more = ((F.col("given") < n) & (F.col("up") <= n - F.col("given"))).cast("int")
    return given.select(stratum, F.least("rows", F.col("take") + more).alias("take"))


def disjoint(rows: DataFrame, key: str, group: str, demo: int, evaluated: int, seed: int) -> DataFrame:
    """`demo` rows of the group of least digest and `evaluated` rows of the other groups; each task keeps no more than that."""
    first = rows.select(group).distinct().orderBy(draw(F.col(group), seed)).limit(1).withColumn("_demo", F.lit(True))
    marked = rows.join(F.broadcast(first), group, "left").withColumn("split", F.when(F.col("_demo"), "demo").otherwise("eval"))
    k = F.row_number().over(Window.partitionBy("split").orderBy(draw(F.col(key), seed), key))
    return marked.withColumn("_k", k).filter(F.col("_k") <= F.when(F.col("split") == "demo", demo).otherwise(evaluated)).select(key, group, "split")
