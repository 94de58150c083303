"""Near-duplicates of a whole table against an exact join in plain Python."""

import re
from collections import defaultdict

import duckdb

from fieldweave.llm import queries

SF = "/root/testdata/sf0.1"


def shingles(text):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def by_hand(rows):
    """Links between different sets by their rarest shingles (a prefix that no pair of 0.8 can miss), confirmed on full sets."""
    sets = defaultdict(list)
    for i, text in rows:
        sets[shingles(text)].append(i)
    seen = defaultdict(int)
    for s in sets:
        for x in s:
            seen[x] += 1
    root = {i: i for _, ids in sets.items() for i in ids}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def unite(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    held, links = defaultdict(list), 0
    for s in sorted((s for s in sets if s), key=len):
        for i in sets[s]:
            unite(i, sets[s][0])
        order = sorted(s, key=lambda x: (seen[x], x))
        prefix = order[: len(s) - (4 * len(s) + 4) // 5 + 1]
        for other in {o for x in prefix for o in held[x] if 10 * len(o) >= 8 * len(s)}:
            both = len(s & other)
            if 100 * both >= 80 * (len(s) + len(other) - both):
                unite(sets[s][0], sets[other][0])
                links += 1
        for x in prefix:
            held[x].append(s)
    return {i: (len(s), find(i)) for s, ids in sets.items() for i in ids}, links


def test_no_link_is_lost(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want, links = by_hand(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op6_near_dup(spark, SF).collect()}
    wrong = {i: (got.get(i), w) for i, w in want.items() if got.get(i) != w}
    assert links > 50 and len(got) == len(want) and not wrong
