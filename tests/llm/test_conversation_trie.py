"""The prefix trie of conversations against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldweave.llm import conversation_trie


def by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: t[:2])
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = [t[2:] for t in own.get(c - c % 5, [])[:h] + own[c][h:]]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        if node:
            up = node[:-1]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed, n, hot=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.15:
            continue
        shared = rng.random() < 0.5
        for t in range(rng.randint(1, 12)):
            same = shared and t < 6
            text = rng.choice(["", None, "hi", "é"]) if not same else f"turn {t} {rng.randint(0, 1)}"
            rows.append((c, t if rng.random() < 0.99 or t else None, rng.choice(["user", None]) if not same else "user", text))
    rows += [(1000 + 5 * i, t, "user", f"same {t}") for i in range(hot) for t in range(4)]
    rows += [(2003, t, "a", f"long {t % 7}") for t in range(900)] + [(2004, t, "a", f"long {t % 7}") for t in range(901)]
    return rows + [(None, 0, "user", "lost")]


@pytest.mark.parametrize(("seed", "n", "hot", "heavy"), [(1, 60, 0, 1024), (2, 90, 40, 5), (3, 40, 30, 1), (4, 1, 0, 1)])
def test_trie(spark, seed, n, hot, heavy):
    rows = table(seed, n, hot)
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, depth long").repartition(3)
    got = sorted((tuple(r) for r in conversation_trie.build(df, heavy).collect()), key=str)
    assert got == by_hand(rows)


def test_turnless_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie.build(spark.createDataFrame([], schema)).collect() == []
    lone = [(c, 0, "user", "x") for c in range(1, 5)]  # nothing to take over: those with h > 0 have no turns
    got = sorted((tuple(r) for r in conversation_trie.build(spark.createDataFrame(lone, schema)).collect()), key=str)
    assert got == by_hand(lone)


def test_repeated_turns_are_turns(spark):
    rows = [(0, 0, "user", "x")] * 3 + [(7, 0, "user", "x")] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in conversation_trie.build(df).collect()), key=str)
    assert got == by_hand(rows)


def test_layout_by_parts(monkeypatch, spark):
    """Shards laid out a few nodes at a time give the same."""
    rows = table(5, 80, 20)
    monkeypatch.setattr(conversation_trie, "LAYOUT_NODES", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in conversation_trie.build(df, 3).select("*").withColumn("one", F.lit(1)).drop("one").collect()), key=str)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == by_hand(rows)
