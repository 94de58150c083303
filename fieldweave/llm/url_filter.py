"""URL filters (operator 10): a temporal list join. Dated list entries become validity intervals, and every capture is held
against the entries that were active when it was fetched.

An entry names a domain (a final dot aside) and covers its subdomains; one of a single label covers only the host of that name. Captures meet as distinct (host, time) pairs before the list is joined,
so a host with very many captures is judged once a day; the verdicts are joined back, where a hot host can be split.

A null or unusable URL has no host and is never blocked; a null time matches no interval; of several entries of a domain on
one day a block wins; repeated captures are judged alike; extra columns are ignored; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-cased host of a URL, without user, port and a final dot; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, since, until (exclusive; null: still active) of blocks, from dated entries (domain, day, action 'block' or 'allow')."""
    daily = entries.filter("domain is not null and day is not null").groupBy(F.regexp_replace(F.lower("domain"), r"\.$", "").alias("domain"), "day").agg(F.min(F.when(F.col("action") == "block", 0).otherwise(1)).alias("allowed"))
    after = F.lead("day").over(Window.partitionBy("domain").orderBy("day"))
    return daily.withColumn("until", after).filter("allowed = 0").select("domain", F.col("day").alias("since"), "until")


def suffixes(name: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, day, blocked, rule (the longest domain that blocks), since, of every capture (page_id, url, day)."""
    seen = captures.select("page_id", host(F.col("url")).alias("host"), "day")
    asked = seen.filter("host is not null and day is not null").select("host", "day").distinct()
    listed = intervals(entries)
    wide = asked.select("host", "day", F.explode(suffixes(F.col("host"))).alias("domain"))
    active = wide.join(listed, "domain").filter("day >= since and (until is null or day < until)")
    longest = F.max(F.struct(F.length("domain").alias("n"), "domain", "since")).alias("hit")
    verdict = active.groupBy("host", "day").agg(longest).select("host", "day", F.col("hit.domain").alias("rule"), F.col("hit.since").alias("since"))
    out = seen.join(verdict, ["host", "day"], "left")
    return out.select("page_id", "host", "day", F.col("rule").isNotNull().alias("blocked"), "rule", "since")
