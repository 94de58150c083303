"""Answers of models: written cases of unwrapping, other names, coercions and warnings."""

import json

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import answers as A


def records(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").withColumn("r", A.llm_record(F.col("raw"))).orderBy("i")
    return [r and ({x["field"]: x for x in r["fields"]}, r["warnings"]) for r in (row["r"] for row in df.collect())]


def test_wrapped_fields(spark):
    raw = """```json
    {"record": {"catalog_number": {"text": "E00633257", "confidence": 0.8}}}
    ```"""
    (fields, warnings), unrelated = records(spark, [raw, '{"note": "not an extraction"}'])
    assert fields["catalogNumber"]["value"] == "E00633257" and fields["catalogNumber"]["confidence"] == 0.8 and fields["catalogNumber"]["evidence_span"] == "E00633257"
    assert unrelated is None and warnings == [] and fields["country"]["value"] == ""


def test_missing_fields_and_clipped_confidence(spark):
    raw = json.dumps({"catalogNumber": {"value": "E123", "confidence": 2, "evidence_span": "E123"}, "decimalLatitude": {"value": "91", "confidence": 0.5, "evidence_span": "91"}})
    [(fields, warnings)] = records(spark, [raw])
    assert fields["catalogNumber"]["confidence"] == 1.0 and "scientificName" in fields
    assert warnings == ["confidence_out_of_range:catalogNumber", "decimalLatitude_out_of_range"]


def test_coercions(spark):
    raws = [
        '[{"country": "Cuba"}]', '[{"country": "Cuba"}, 1]', '"text"', "", None, 'said: {"Country": "x", "country": null} end', '{"data": [1], "result": {"Barcode": {"answer": 5, "evidence_span": "n 5"}}}',
        '{"country": {"value": true, "confidence": "0.7"}, "eventDate": {"value": "1921", "confidence": "high"}, "recordedBy": {"confidence": null, "value": "X"}}',
        '{"state": "A", "province": {"value": "B"}}', '{"typeStatus": {"prediction": "holotype"}, "decimalLongitude": "far"}', '{"fields": {"x": 1}, "country": "Cuba"}', '{"country": {"note": 1}}', '{"country": ["a", 1]}',
    ]
    got = records(spark, raws)
    assert got[0][0]["country"]["value"] == "Cuba" and got[0][0]["country"]["confidence"] == 0.5 and got[0][1] == ["coerced_field:country"]
    assert got[1] is got[2] is got[3] is got[4] is None
    assert got[5][0]["country"]["value"] == "" and got[5][1] == ["coerced_field:country"]
    assert got[6][0]["catalogNumber"]["value"] == "5" and got[6][0]["catalogNumber"]["confidence"] == 0.5 and got[6][0]["catalogNumber"]["evidence_span"] == "n 5"
    assert got[7][0]["country"]["value"] == "True" and got[7][0]["country"]["confidence"] == 0.7
    assert got[7][0]["eventDate"]["confidence"] == 0.0 and set(got[7][1]) == {"bad_confidence:eventDate", "bad_confidence:recordedBy"}
    assert got[8][0]["stateProvince"]["value"] == "B"  # the last of two names counts
    assert got[9][0]["typeStatus"]["value"] == got[9][0]["typeStatus"]["evidence_span"] == "holotype" and got[9][1] == ["coerced_field:decimalLongitude", "decimalLongitude_not_numeric"]
    assert got[10] is None  # the container hides what stands beside it
    assert got[11][0]["country"]["value"] == "" and got[11][1] == [] and got[12][0]["country"]["value"] == '["a",1]'


def vision(spark, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string").withColumn("r", A.vision_answer(F.col("raw"))).orderBy("i")
    return [row["r"] for row in df.collect()]


def test_vision_answers(spark):
    text = "Herb. Kew\nR. E. Holttum\n22 July 1954"
    full = {"transcriptions": [{"image_index": 1, "text": text, "uncertain_spans": ["1954"]}], "fields": {"recordedBy": {"value": "R. E. Holttum", "confidence": 0.91, "evidence_span": "R. E. Holttum"}, "eventDate": {"value": "1954-07-22", "confidence": 0.8, "evidence_span": "22 July 1954"}}, "observations": ["handwritten"]}
    odd = {"transcriptions": ["a", 5, {"text": " b ", "uncertain_spans": "u"}, {"image_index": 9, "text": None}], "fields": [1], "observations": "one"}
    lone = {"transcriptions": {"text": "x", "uncertain_spans": [" ", "y", None]}, "fields": {"country": 3}}
    one, two, three, none, nothing = vision(spark, [json.dumps(full), f"```json\n{json.dumps(odd)}\n```", f"so: {json.dumps(lone)}.", "[1]", "no"])
    assert one["full_transcription"] == text and one["transcriptions"][0]["uncertain_spans"] == ["1954"] and one["observations"] == ["handwritten"]
    assert {x["field"]: x["value"] for x in one["fields"]}["recordedBy"] == "R. E. Holttum" and one["warnings"] == []
    assert [tuple(t) for t in two["transcriptions"]] == [("1", "a", []), ("3", "b", ["u"]), ("9", "", [])] and two["full_transcription"] == "a\n\nb" and two["observations"] == ["one"]
    assert [tuple(t) for t in three["transcriptions"]] == [("1", "x", ["y"])] and three["warnings"] == ["coerced_field:country"] and three["observations"] == []
    assert none is None and nothing is None


def test_flat_columns(spark):
    df = spark.createDataFrame([('{"country": {"value": "Cuba", "confidence": 0.4}}',), ("none",)], "raw string")
    rows = df.select(*A.flat(A.llm_record(F.col("raw")))).collect()
    assert len(rows[0]) == 28 and rows[0]["country"] == "Cuba" and rows[0]["country_confidence"] == 0.4 and rows[1]["country"] == "" and rows[1]["validation_warnings"] == ""
    fields = spark.createDataFrame([({"country": ("Cuba", "r1", "Cuba", ["r1:x"], [], 0.4, True)},)], "f map<string,struct<value:string,source:string,span:string,supporting:array<string>,alternatives:array<string>,confidence:double,review:boolean>>")
    row = fields.select(*A.flat_reconciled(F.col("f"))).first()
    assert len(row) == 63 and row["country_supporting_sources"] == '["r1:x"]' and row["country_review_required"] and row["eventDate"] == "" and row["eventDate_alternative_candidates"] == "[]"


@pytest.mark.parametrize(("text", "want"), [("[1, 2.5, 3.5, 4]", [1, 2, 4, 4]), ("[1, 2]", [0] * 4), ("box", [0] * 4), (None, [0] * 4), ("[1, null, 2, 3]", [0] * 4), ("[-1.6, 0, 9, 1e2]", [-2, 0, 9, 100])])
def test_boxes(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(A.parsed_box(F.col("c"))).first()[0] == want


def test_detections_and_json_values(spark):
    rows = spark.createDataFrame([('{"boxes": [[0, 0, 1, 1], [2, 2, 3.5, 3]], "scores": [0.2, 0.9], "labels": ["a", "b"]}',), ("x",)], "c string")
    got = [r[0] for r in rows.select(A.detections(F.col("c"))).collect()]
    assert [(x["label"], x["confidence"], x["box"]) for x in got[0]] == [("b", 0.9, [2, 2, 4, 3]), ("a", 0.2, [0, 0, 1, 1])] and got[1] == []
    values = spark.createDataFrame([("[1]",), ("bad",), (None,)], "c string").select(F.to_json(A.json_value(F.col("c"), F.parse_json(F.lit("{}"))))).collect()
    assert [v[0] for v in values] == ["[1]", "{}", "{}"]
