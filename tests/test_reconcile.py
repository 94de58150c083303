"""Reconciled fields, the leak gate and hybrid ranking on written cases."""

import pytest

from fieldweave.operators import reconcile, retrieval, sets

FIELD = "id long, field string, value string, confidence string, span string, source string, alternatives array<string>, review boolean"


def test_validated(spark):
    readings = spark.createDataFrame([(1, "a", 1, " Collected in Kenya "), (1, "a", 0, None), (1, "b", 0, "nan")], "id long, region string, pos int, text string")
    rows = [
        (1, "held", "Kenya", "0.4", "in KENYA", "a", None, None), (1, "other region", "Kenya", "0.4", "Kenya", "b", ["x"], False), (1, "no region", "Kenya", "7", "Kenya", "c", None, False),
        (1, "no span", "Kenya", "0.4", None, "a", None, False), (1, "blank", None, "NaN", "", "", [" ", None], False), (2, "no texts", "x", None, "x", "a", None, False),
    ]
    fields = spark.createDataFrame(rows, FIELD)
    got = {r["field"]: r for r in reconcile.validated(fields, reconcile.region_texts(readings, "id", "region", "pos", "text"), "id", "region").collect()}
    assert {k: r["value"] for k, r in got.items()} == {"held": "Kenya", "other region": "", "no region": "", "no span": "", "blank": "", "no texts": ""}
    assert {k for k, r in got.items() if r["review"]} == {"other region", "no region", "no span", "no texts"}
    assert (got["held"]["confidence"], got["blank"]["confidence"], got["other region"]["alternatives"], got["held"]["span"]) == (0.4, 0.0, [], "in KENYA")
    assert reconcile.validated(fields.limit(0), reconcile.region_texts(readings.limit(0), "id", "region", "pos", "text"), "id", "region").count() == 0


def test_attributed(spark):
    readings = spark.createDataFrame([(1, "b", 1, "Kenya 1960", "x"), (1, "a", 2, "kenya", "x"), (1, "b", 3, "KENYA", "y"), (1, "c", 0, None, "x")], "id long, region string, pos int, text string, engine string")
    values = spark.createDataFrame([(1, "country", "Kenya", "kenya"), (1, "none", "Cuba", "Cuba"), (1, "blank", "", "kenya"), (2, "country", "Kenya", "kenya")], "id long, field string, value string, span string")
    got = {(r["id"], r["field"]): (r["source"], r["supporting"]) for r in reconcile.attributed(values, readings, "id", "region", "pos", "text", "engine").collect()}
    assert got == {(1, "country"): ("b", ["b:x", "b:y"]), (1, "none"): ("", []), (1, "blank"): ("", []), (2, "country"): ("", [])}


def test_leaks(spark):
    of = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    assert sets.assert_no_leak(of("a", "", None), of("b", "", None), "key").count() == 3
    with pytest.raises(ValueError, match="b"):
        sets.assert_no_leak(of("a", " b"), of("b ", "c"), "key")


def test_hybrid_weights(spark):
    """A vector decides where words are equal; the group tips equal vectors; the query is no hit of its own."""
    rows = [(1, [1.0, 0.0], "red", "g"), (2, [0.9, 0.0], "blue", ""), (3, [0.0, 1.0], "red", ""), (4, [0.9, 0.0], "green", " g "), (5, [0.0, 0.0], None, None)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>, text string, g string")
    got = {r["doc"]: (r["rank"], round(r["score"], 6)) for r in retrieval.hybrid(corpus.filter("id = 1"), corpus, "id", "v", "text", "g", 4).collect()}
    assert got == {4: (1, 0.505), 3: (2, 0.45), 2: (3, 0.405), 5: (4, 0.0)}
