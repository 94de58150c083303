"""Every registered query that SQL can express gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from fieldweave import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_parity(spark, name):
    got = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    expected = sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()), key=str)
    assert len(rows) == len(expected)
    assert all(same(x, y) for a, b in zip(rows, expected) for x, y in zip(a, b))


def test_suppression_by_brute_force(spark):
    kept = {(r["record"], r["id"]) for r in catalog.queries()["box_overlap"](spark, SF).collect()}
    groups = {}
    for b in catalog._boxes(spark, SF).collect():
        groups.setdefault(b["record"], []).append(b)

    def iou(a, b):
        w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
        i = max(w, 0) * max(h, 0)
        return i / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - i)

    want = set()
    for record, boxes in groups.items():
        chosen = []
        for b in sorted(boxes, key=lambda b: (-b.confidence, b.id)):
            if not any(k.label == b.label and iou(k, b) >= 0.45 for k in chosen):
                chosen.append(b)
        want |= {(record, b.id) for b in chosen}
    assert kept == want
