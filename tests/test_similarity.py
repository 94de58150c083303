"""Likeness of texts against the standard library and against all windows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import similarity as S


def test_matching_ratios_are_the_library_s():
    rng = random.Random(4)
    pairs = []
    for alphabet in ("ab", "abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"):
        for _ in range(150):
            a = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            b = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            pairs += [(a, b), (a, a[:10] + b + a[20:]), (a, "".join(rng.sample(a, len(a))))]
    for n in (199, 200, 230, 700):  # from 200 characters on, popular ones start no block
        a = "".join(rng.choice("abcdefgh") for _ in range(n))
        pairs += [(a, a[: n // 2] + "zz" + a[n // 2 :]), (a, a[::-1]), (a[:50], a), ("é漢" + a, a + "漢")]
    got = S.matching_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_many_cells(monkeypatch):
    monkeypatch.setattr(S, "_CELLS", 64)
    test_matching_ratios_are_the_library_s()


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def by_windows(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return float(not long)
    m = len(short)
    ways = [(short, long)] + [(long, short)] * (len(a) == len(b))
    return max(2 * common(s, w) / (m + len(w)) for s, t in ways for i in range(1 - m, len(t)) if (w := t[max(i, 0) : i + m]))


def test_window_ratios_by_brute_force():
    rng = random.Random(5)
    pairs = []
    for _ in range(120):
        text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
        pairs.append((text(rng.randint(0, 12)), text(rng.randint(0, 40))))
    long = "".join(rng.choice("abcdefgh") for _ in range(150))
    pairs += [(long[20:100], long), (long[:64], long[3:]), (long[:65] + "x" * 70, long), ("abc", "abc"), ("", "")]
    assert S.window_ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == pytest.approx([by_windows(a, b) for a, b in pairs])


def test_columns(spark):
    rows = [("L.2180891", "l 2180891"), ("", "x"), (None, "x"), ("K. Lahti", "Lahti, K."), ("abc", "abc"), ("--", "--")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(S.text_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [1.0, 0.0, 0.0] and 0 < got[3] < 1 and got[4:] == [1.0, 0.0]
    nulls = [r[0] for r in df.select(S.matching_ratio(F.col("a"), F.col("b"))).collect()]
    assert nulls[2] is None and nulls[4] == 1.0


def test_presence(spark):
    rows = [("Rosa canina", "label: ROSA  canina, L."), ("Rosa canina", "Rosa c anina"), ("", "x"), (None, "x"), ("Rosa", ""), ("Rosa", None)]
    df = spark.createDataFrame(rows, "v string, t string")
    got = [tuple(r) for r in df.select(S.literal_presence(F.col("v"), F.col("t")), F.round(S.normalised_presence(F.col("v"), F.col("t")), 6)).collect()]
    assert [g[0] for g in got] == [1, 0, None, None, 0, 0]
    assert got[0][1] == 1.0 and got[1][1] == pytest.approx(by_windows("rosa canina", "rosa c anina"), abs=1e-6)
    assert [g[1] for g in got[2:]] == [None, None, 0.0, 0.0]
