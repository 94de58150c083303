"""Like names among many: keys meet by equal parts of their sets of letter groups, and no pair is missed."""

import random

import pytest
from pyspark.sql import functions as F
from test_authority import groups, words

from fieldweave.operators import authority


@pytest.mark.parametrize("few", [6, 64])
def test_like_one_another_misses_no_pair(spark, monkeypatch, few):
    monkeypatch.setattr(authority, "FEW", few)
    rng = random.Random(5)
    base = words(4, 60, "abcdefgh", 24)
    names = sorted({*base, *("".join(c for c in w if rng.random() > 0.05) + rng.choice(["", "a", "xy"]) for w in base for _ in range(3))})
    df = spark.createDataFrame([(w,) for w in names], "key string")
    for t in (0.75, 0.92):
        got = [(r["key"], r["of"]) for r in authority.like_one_another(df, t).collect()]
        cosine = lambda x, y: len(groups(x) & groups(y)) / (len(groups(x)) * len(groups(y))) ** 0.5
        want = {(x, y) for x in names for y in names if x < y and round(cosine(x, y), 9) >= t}
        assert len(got) == len(set(got)) and set(got) == want and len(want) >= 5


def test_names_that_share_a_rare_group_do_not_meet(spark):
    """Names of one rare beginning are no candidates of one another: pairs that meet would grow with the square of the names."""
    rng = random.Random(6)
    names = sorted({f"Quvx {''.join(rng.choice('abcdefghijklmnop') for _ in range(16))}" for _ in range(300)})
    df = spark.createDataFrame([(n,) for n in [*names, names[0] + "q"]], "key string")
    sized = df.select("key", authority.letter_groups(F.col("key")).alias("groups")).withColumn("size", F.size("groups"))
    met = authority.met_by_parts(sized, 0.92)
    assert met.filter(F.col("of") == names[0] + "q").count() >= 1 and met.count() < 300
