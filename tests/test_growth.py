"""Joins and tasks that grow with the tables: nothing whole through the driver, no long work in the few splits of a file."""

import contextlib
import hashlib
import io
import math
import re

from pyspark.sql import functions as F

from fieldweave import catalog
from fieldweave.functions import text as text_functions
from fieldweave.operators import authority, reconcile, retrieval, summaries

SF = "/root/testdata/sf0.001"


def plan(frame):
    with contextlib.redirect_stdout(out := io.StringIO()):
        frame.explain()
    return out.getvalue()


def test_evaluation_broadcasts_no_records(spark):
    for name in ("eval_detail", "eval_by_tertile", "proxy_by_field", "branch_fields"):
        assert "BroadcastHashJoin" not in plan(catalog.queries()[name](spark, SF)), name


def test_one_resolved_value_a_record(spark):
    fields = spark.createDataFrame([(1, "a", "x", [], False)], "r int, field string, value string, alternatives array<string>, review boolean")
    resolved = spark.createDataFrame([(1, "B-1", False), (1, "B-2", True), (1, " ", False)], "r int, value string, review boolean")
    got = reconcile.overridden(fields, resolved, "r", "a").collect()
    assert [(g["value"], list(g["alternatives"]), g["review"]) for g in got] == [("B-2", ["x"], True)]


def test_draws_of_many_records_at_once():
    records, n = ["7", "é", "None"], 10
    for record, row in zip(records, summaries.times_drawn(records, n)):
        own = b"".join(hashlib.md5(f"{record}|{i}".encode()).digest() for i in range(3))
        chances = [int.from_bytes(own[4 * i : 4 * i + 4], "big") / 2**32 for i in range(n)]
        assert [int(x) for x in row] == [sum(c >= least for least in summaries.DRAWS) for c in chances]


def test_scores_of_a_query_need_no_shuffle_of_pairs(spark):
    for name in ("lexical_topk", "tfidf_topk"):
        assert not re.search(r"Exchange hashpartitioning\(query#\d+L?, (doc|term)#", plan(catalog.queries()[name](spark, SF))), name


def test_like_names_meet_as_keys_alone(spark):
    names = spark.createDataFrame([(n,) for n in ("Rosa canina alba", "Rosa canina albo", "Abies alba", "Rosa canina")], "key string")
    met = authority.like(names, names, 0.7)
    assert not re.search(r"all_(key|of)", plan(met))
    groups = lambda s: {f" {s} "[i : i + 3] for i in range(len(s))}
    keys = [r["key"] for r in names.collect()]
    alike = lambda a, b: len(groups(a) & groups(b)) / math.sqrt(len(groups(a)) * len(groups(b)))
    assert {(r["key"], r["of"]) for r in met.collect()} == {(a, b) for a in keys for b in keys if alike(a, b) >= 0.7}


def test_hybrid_pairs_never_become_rows(spark, monkeypatch):
    """Slices and blocks of a few rows give what all pairs give; only the best of each pair of slices are ranked."""
    monkeypatch.setattr(retrieval, "SLICE_WORDS", 7)
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    rows = [(i, None if i == 5 else [i % 3 / 4, i % 5 / 4], None if i == 9 else " ".join(w for w in ("red", "blue", "oak", "elm", "fir") if (i * 7 + len(w) * 3 + ord(w[0])) % 4), "g" if i % 2 else "") for i in range(1, 14)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>, text string, g string")
    queries = corpus.filter("id % 4 = 1")
    found = retrieval.hybrid(queries, corpus, "id", "v", "text", "g", 3)
    assert not re.search(r"hashpartitioning\(query#\d+L?, doc#", plan(found))
    renamed = lambda f, name: f.select(F.col("id").alias(name), "text")
    scores = lambda of: {(r["query"], r["doc"]): r["score"] for r in of(renamed(queries, "query"), renamed(corpus, "doc")).collect()}
    words = scores(retrieval.lexical_scores), scores(retrieval.tfidf_scores)
    want = {}
    for q, v, _, g in rows:
        if q % 4 == 1:
            score = lambda r: None if v is None or r[1] is None else round(0.45 * sum(a * b for a, b in zip(v, r[1])) + 0.45 * sum(w.get((q, r[0]), 0.0) for w in words) / 2 + 0.1 * (g == r[3] != ""), 6)  # noqa: B023, E731
            hits = sorted(((score(r), r[0]) for r in rows if r[0] != q), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:3]
            want |= {(q, i + 1): hit for i, hit in enumerate(hits)}
    assert {(r["query"], r["rank"]): (None if r["score"] is None else round(r["score"], 6), r["doc"]) for r in found.collect()} == want


def test_values_are_normalised_by_one_expression(spark):
    """Identifiers seen are normalised below the methods and fields, and values by one expression that the JVM still compiles."""
    text = plan(catalog.queries()["eval_detail"](spark, SF))
    assert max(len(line) for line in text.splitlines()) < 12000 and text.count("regexp_replace(") < 120


def test_cleaning_trims_what_a_pattern_would(spark):
    rows = [" \t\n\x0b\f\r Nan\r\n", None, "", " a b ", "a \u2028", "\u00a0a", " NULL", "x none", "\n\n"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "c string").select(text_functions.clean(F.col("c"))).collect()]
    assert got == ["", "", "", "a b", "a \u2028", "\u00a0a", "", "x none", ""]
