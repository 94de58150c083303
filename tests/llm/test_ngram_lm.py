"""Scores of the trigram model against plain dictionaries, and Elias-Fano sequences against sorted lists."""

import bisect
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import ngram_lm
from fieldweave.llm.elias_fano import EliasFano, pack_bits, read_bits


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1, 1 << 60), (100, 101), (500, 1 << 20), (3000, 1 << 62), (5000, 5001)])
def test_elias_fano(n, top):
    rng = random.Random(n)
    values = sorted(rng.sample(range(top), n)) if top < 1 << 40 else sorted({rng.randrange(top) for _ in range(n)})
    values += [values[-1] + 1 + i for i in range(200)] if n > 1 else []
    seq = EliasFano.of(np.array(values, np.uint64))
    again = EliasFano.from_arrays(*seq.arrays())
    assert again.access(np.arange(len(values))).tolist() == values
    asked = values + [0, 1, top - 1, top, top + 1000] + [rng.randrange(top + 2) for _ in range(300)]
    want = [i if (i := bisect.bisect_left(values, x)) < len(values) and values[i] == x else -1 for x in asked]
    assert again.find(np.array(asked, np.uint64)).tolist() == want


def test_repeated_numbers_keep_their_places():
    values = [0, 0, 0, 7, 7, 9, 9, 9, 9, 4000]
    assert EliasFano.of(np.array(values, np.uint64)).access(np.arange(10)).tolist() == values


@pytest.mark.parametrize("width", [0, 1, 7, 31, 63])
def test_packed_bits(width):
    rng = random.Random(width)
    values = [rng.randrange(1 << width) for _ in range(500)]
    assert read_bits(pack_bits(np.array(values, np.uint64), width), width, np.arange(500)).tolist() == values


def words(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def by_hand(rows, learned):
    one, two, three, after = Counter(), Counter(), Counter(), defaultdict(set)
    for i, t in rows:
        if learned(i):
            seq = ["<", "<", *words(t)]
            one.update(seq[2:])
            for a, b, c in zip(seq, seq[1:], seq[2:]):
                two[b, c] += 1
                three[a, b, c] += 1
                after[a, b].add(c)
    total, distinct = sum(one.values()), len(one)
    two["<", "<"] = one[None]
    context = lambda v: one[v] if v != "<" else one[None]
    out = []
    for i, t in rows:
        seq = ["<", "<", *words(t)]
        base = score = 0.0
        for a, b, c in zip(seq, seq[1:], seq[2:]):
            p1 = (one[c] + 0.1) / (total + 0.1 * (distinct + 1))
            p2 = (two[b, c] + ngram_lm.PRIOR * p1) / (context(b) + ngram_lm.PRIOR)
            n = two[a, b]
            p3 = max(three[a, b, c] - ngram_lm.DISCOUNT, 0) / n + ngram_lm.DISCOUNT * len(after[a, b]) / n * p2 if n else p2
            base, score = base + math.log10(p1), score + math.log10(p3)
        out.append((i, len(seq) - 2, sum(one[c] > 0 for c in seq[2:]), total, base, score))
    return sorted(out, key=str)


def texts():
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["the", "of", "a", "b", "cat", "Über", "x1"]) + rng.choice(["", "", "s", str(rng.randint(0, 30))]) for _ in range(n))
    return [None, "", " \n ", "one", "The THE the", "of the", *(prose(rng.randint(1, 80)) for _ in range(60)), prose(20000), "same words again", "same words again"]


@pytest.mark.parametrize("block", [8 << 20, 2000])
def test_scores(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", block)
    rows = list(enumerate(texts())) + [(5, "of the")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, learned string").repartition(3)
    rule = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    got = sorted((tuple(r) for r in ngram_lm.score(df, rule).collect()), key=str)
    want = by_hand(rows, lambda i: zlib.crc32(str(i).encode()) % 10 != 0)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert math.isclose(g[4], w[4], rel_tol=1e-9)
        assert abs(g[5] - w[5]) <= 4e-4 * g[1]


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert ngram_lm.score(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    untaught = ngram_lm.score(spark.createDataFrame([(None, "a b"), (2, None)], schema), F.lit(None).cast("boolean")).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["score"] <= 0 for r in untaught) and len(untaught) == 2


def test_wide_ids(spark):
    """Orders of three columns that don't fit into one number."""
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 1 << 40, 200) % 5 + (1 << 39) for _ in range(3))
    o = ngram_lm._ordered(a, b, c)
    assert sorted(zip(a.tolist(), b.tolist(), c.tolist())) == list(zip(a[o].tolist(), b[o].tolist(), c[o].tolist()))


def test_a_share_sums_to_one():
    """Over all words, the end and the unknown word, each level of the trie's model is a distribution."""
    u, v = np.array([1, 1, 2], np.uint64), np.array([3, 5, 1], np.uint64)
    of, w, c = np.array([0, 0, 1, 2, 2, 2]), np.array([4, 9, 9, 1, 2, 3], np.uint64), np.array([1, 7, 2, 1, 1, 500])
    trie = ngram_lm.Trie.of(u, v, of, w, c)
    count, lower, share = trie.find(u, v, np.array([2, 1, 3]), w)
    for i in range(3):
        assert abs(ngram_lm.from_steps(count[i : i + 1], 0)[0] - c[of == i].sum()) < 0.2
        assert abs(ngram_lm.from_steps(share[of == i], 15).sum() + ngram_lm.from_steps(lower[i : i + 1], 15)[0] - 1) < 1e-3
    none = trie.find(np.array([1, 7], np.uint64), np.array([4, 3], np.uint64), np.array([1, 1]), np.array([9, 9], np.uint64))
    assert all((x == 0).all() for x in none)
