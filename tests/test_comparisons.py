"""Comparisons of methods: written cases of verdicts, gates and rows of extraction."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import similarity
from fieldweave.operators import comparisons as C

DETAIL = "record long, field string, method string, exact_match int, token_f1 double, evaluable int, not_evaluated boolean, parse_failure boolean"


def said(spark, rows):
    r = C.verdict(spark.createDataFrame(rows, DETAIL)).first()
    return r["control"], r["tested"], r["mean_delta"], r["verdict"]


def one(method, f1=0.5, record=1, evaluable=1, held=False, failed=False):
    return (record, "country", method, 0, f1, evaluable, held, failed)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([one("a_no_rag", 0.2), one("a_rag", 0.7)], "improved mean token F1 by 0.500"), ([one("a_no_rag", 0.7), one("a_rag", 0.2)], "reduced mean token F1 by 0.500"), ([one("a_no_rag"), one("a_rag")], "no average difference"),
        ([one("a_no_rag")], "unavailable: only the control was run"), ([one("a_rag")], "unavailable: the control was not run"), ([one("rule_ocr")], "unavailable: neither method was run"), ([], "unavailable: neither method was run"),
        ([one("a_no_rag", held=True), one("a_rag", held=True)], "unavailable: neither method was evaluated"), ([one("a_no_rag", failed=True), one("a_rag", failed=True)], "unavailable: no output of either could be parsed"),
        ([one("a_no_rag", evaluable=0), one("a_rag")], "unavailable: the methods did not both give outputs to evaluate"), ([one("a_no_rag", None), one("a_rag")], "inconclusive: no comparable scores"),
    ],
)
def test_verdicts(spark, rows, want):
    assert said(spark, rows)[3] == want


def test_helped_and_hurt(spark):
    rows = [one("a_no_rag", 0.1 * i, i) for i in range(8)] + [one("a_rag", 0.3, i) for i in range(8)]
    got = C.helped_and_hurt(C.method_delta(spark.createDataFrame(rows, DETAIL)), 2).collect()
    assert sorted((r["side"], r["record"]) for r in got) == [("helped", 0), ("helped", 1), ("hurt", 3), ("hurt", 4)]


def test_missing_predictions_count_as_zero(spark):
    predicted = spark.createDataFrame([(1, "b", None, "True"), (2, "b", "Cuba", "0"), (3, "b", "x", "no"), (9, "b", "x", "1")], "record long, branch string, country string, country_review_required string")
    gold = spark.createDataFrame([(1, "Cuba"), (2, " cuba "), (3, "")], "record long, country string")
    got = {r["record"]: r for r in C.branch_detail(predicted, gold, ["country"]).collect()}
    assert set(got) == {1, 2} and (got[1]["coverage"], got[1]["exact_match"], got[1]["token_f1"], got[1]["review_required"]) == (0.0, 0, 0.0, True)
    assert (got[2]["exact_match"], got[2]["token_f1"], got[2]["review_required"]) == (1, 1.0, False)


READINGS = "record string, engine string, status string, text string"


def test_the_gate_stops_without_text(spark):
    rows = [("eval:1", "trocr_small", "model_load_error", " "), ("demo:1", "trocr_small", "ok", "text of another set"), ("eval:1", "other", "ok", "x")]
    wanted = spark.createDataFrame([("eval:1",)], "record string")
    with pytest.raises(RuntimeError, match="1 attempts, 0 non-empty outputs; model_load_error"):
        C.require_readings(spark.createDataFrame(rows, READINGS), "trocr_", wanted)
    assert C.require_readings(spark.createDataFrame(rows, READINGS), "trocr_") == 1
    with pytest.raises(RuntimeError, match="0 attempts, 0 non-empty outputs; no rows"):
        C.require_readings(spark.createDataFrame([], READINGS), "trocr_")
    many = spark.createDataFrame([("a", "trocr_x", f"s{i}", None) for i in range(9)], READINGS)
    with pytest.raises(RuntimeError, match="s0; s1; s2; s3; s4$"):
        C.require_readings(many, "trocr_")


def test_prompt_digest_is_that_of_the_json(spark):
    prompt = 'a "quoted"\nline é'
    got = spark.range(1).select(C.prompt_digest(F.lit("Return JSON."), F.lit(prompt))).first()[0]
    messages = [{"role": "system", "content": "Return JSON."}, {"role": "user", "content": prompt}]
    assert got == hashlib.sha256(json.dumps(messages, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_rows_of_an_extraction(spark):
    rule = spark.createDataFrame([(1, "rule", "A"), (2, "rule", "B")], "record long, method string, country string")
    requests = spark.createDataFrame([(1, "", "p1"), (2, "empty_ocr_evidence", "p2"), (3, "", "p3"), (4, "", "p4"), (5, "", "p5")], "record long, gate_reason string, prompt_sha256 string")
    answers = spark.createDataFrame([(1, True, "{}", "Cuba"), (2, True, "{}", "Cuba"), (3, True, "", "Cuba"), (4, False, "no json", None)], "record long, parsed boolean, raw_output string, country string")
    got = {(r["record"], r["method"]): r for r in C.extraction_rows(rule, answers, requests).collect()}
    why = lambda k: (got[k, "model"]["country"], got[k, "model"]["attempted"], got[k, "model"]["not_evaluated_reason"], got[k, "model"]["parse_failure"])
    assert why(1) == ("Cuba", True, "", False) and why(2) == (None, False, "empty_ocr_evidence", False) and why(3) == (None, True, "empty_raw_output", False)
    assert why(4) == (None, True, "", True) and why(5) == (None, True, "empty_raw_output", False) and got[1, "rule"]["country"] == "A" and len(got) == 7


def test_collectors(spark):
    rows = spark.createDataFrame([("R. Holttum", ""), ("", "x"), ("Holttum", "R E Holttum"), ("zz", "R E Holttum")], "t string, s string")
    assert [r[0]["verdict"] for r in rows.select(similarity.collector_reading(F.col("t"), F.col("s"))).collect()] == ["collector_initial", "empty_output", "collector_ocr_agreement", "collector_unconfirmed"]
