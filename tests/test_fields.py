"""Written cases of the rules by field, and a streaming run of the windows."""

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import fields as R
from fieldweave.functions import text as T
from fieldweave.operators import geometry, splits
from fieldweave.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize(
    ("field", "pred", "gold", "exact"),
    [
        ("catalogNumber", "B 10 0355192", "B100355192", 1), ("catalogNumber", "TU 351001", "TU351001", 1), ("eventDate", "19 Aug 1960", "1960-08-19", 1), ("recordedBy", "K. I. Lahtivirta", "Lahtivirta, K. I.", 1),
        ("typeStatus", "Isotype of Carex lutensis", "isotype", 1), ("decimalLatitude", "51.50004", "51.5", 1), ("decimalLatitude", "51.6", "51.5", 0), ("scientificName", "Rosa canina", "rosa canina", 1), ("country", None, "Cuba", 0),
    ],
)
def test_exact(spark, field, pred, gold, exact):
    assert one(spark, R.field_exact(L(field), L(pred).cast("string"), L(gold))) == exact


def test_scores(spark):
    assert one(spark, T.token_f1(L("Rosa"), L("Rosa canina"))) == pytest.approx(2 / 3)
    assert one(spark, T.evidence_proxy(L("Rosa canina"), L("label text Rosa canina here"))) == 1.0
    value = lambda v: R.normal_value(L("eventDate"), L(v))
    assert one(spark, R.f1_of(L("eventDate"), L(0), value("1953-12-05/1953-12-07"), value("1953-12-05"))) > 0
    assert one(spark, value(" 1953-12-05 / 1953-12-07 ")) == "1953-12-05/1953-12-07"


@pytest.mark.parametrize(("flag", "want"), [("False", False), ("0", False), ("True", True), (None, False), ("nan", False), ("maybe", True)])
def test_truthy(spark, flag, want):
    assert one(spark, R.truthy(L(flag).cast("string"))) is want


def test_identifiers(spark):
    assert one(spark, R.identifier_lines(L("BM000625315\n BM000625315 \n591\nBM0006253."))) == ["BM000625315", "BM0006253"]
    assert one(spark, R.plausible_identifier(L("E00633257"))) and not one(spark, R.plausible_identifier(L("591")))
    assert one(spark, R.shape_score(L("E00633257"), ["E"])) == 115.0 and one(spark, R.shape_score(L("591"), [])) == -100.0


def test_evidence_variants(spark):
    assert "29may2006" in one(spark, R.evidence_variants(L("eventDate"), L("2006-05-29")))
    assert one(spark, R.evidence_variants(L("eventDate"), L("2006-05"))) == ["200605", "may2006"]
    assert one(spark, R.date_part_hit("month", L("In May"), L("2006-05-29"))) and one(spark, R.date_part_hit("day", L("x"), L("2006"))) is None


def test_boxes(spark):
    box = lambda *c: F.struct(*(L(v).alias(n) for v, n in zip(c, ("x0", "y0", "x1", "y1"), strict=True)))
    outer, inner = box(0, 0, 100, 100), box(10, 10, 30, 30)
    assert one(spark, geometry.iou(outer, inner)) == pytest.approx(0.04) and one(spark, geometry.containment(outer, inner)) == 1.0
    assert one(spark, R.clamped_box(L(-10), L(20), L(120), L(140), 100, 100)) == [0.0, 0.2, 1.0, 1.0]
    assert one(spark, R.tile_starts(L(2000), 1024, 0.2)) == [0, 819, 976] and one(spark, R.tile_starts(L(500), 1024, 0.2)) == [0]


def test_records_and_rules(spark):
    made = one(spark, R.make_field(L(" x "), L(2.0)))
    assert (made.value, made.confidence, made.evidence_span) == ("x", 1.0, "x")
    assert one(spark, R.record_warnings({"eventDate": L(2.0)}, L("91"), L("west"))) == "confidence_out_of_range:eventDate;decimalLatitude_out_of_range;decimalLongitude_not_numeric"
    found = one(spark, R.coordinates(L("E00633257 Rosa canina France 1902 lat 48.86 lon 2.35")))
    assert (found.latitude, found.longitude) == ("48.86", "2.35")
    assert one(spark, R.component_role(L("Database:Number"))) == "identifier_child" and one(spark, R.component_type(L("specimen label"))) == "primary_specimen_label"


def test_tertiles(spark):
    """Edges that coincide: thirds by rank; two values: halves; none: none."""
    frame = lambda v: spark.createDataFrame(list(enumerate(v)), "k long, v double")
    got = [r.tertile for r in splits.tertiles(frame([0.0, 0.0, 0.0, 0.0, 0.0, 0.2, 0.3, 0.4, 0.5, 1.0]), "v").orderBy("k").collect()]
    assert got == ["low"] * 3 + ["medium"] * 3 + ["high"] * 4
    assert [r.tertile for r in splits.tertiles(frame([0.0, 1.0, 1.0]), "v").orderBy("k").collect()] == ["low", "high", "high"]
    assert splits.tertiles(frame([0.0]).limit(0), "v").count() == 0


def test_streamed_windows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 03:00:00", "b")], "ts string, kind string").select(F.to_timestamp("ts").alias("ts"), "kind")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run = windows.counts(stream, "ts", "kind", "1 hour", "10 minutes").writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r.kind, r.n) for r in spark.table("windowed").collect()] == [("a", 2)]


@pytest.mark.parametrize(("text", "identifier", "date"), [("Sheet E00633257 of 1921-03", "E00633257", "1921-03"), ("BM 000625315 in 1899", "BM000625315", "1899"), ("BM-000625315", "BM000625315", ""), ("BM\t000625315 2100", "", ""), ("x", "", ""), ("2001-02-03 and 1999", "", "2001-02-03")])
def test_identifiers_and_dates_in_texts(spark, text, identifier, date):
    assert one(spark, R.identifier_in(L(text))) == identifier and one(spark, R.date_in(L(text))) == date
