"""The choice of regions: role rules, geometry, texts and masks, gates, quotas and the tables of branches."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from fieldweave import catalog
from fieldweave.operators import crops, geometry

SCHEMA = "record long, id string, label string, confidence double, text string, decoded string, utility double, x0 int, y0 int, x1 int, y1 int, overlaps map<string,double>"


def region(id, label, box, confidence=0.8, text="visible text", utility=50.0, overlaps=None, decoded="", record=1):
    return (record, id, label, confidence, text, decoded, float(utility), *box, overlaps)


def settled(spark, rows):
    done = crops.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r["id"]: (r["duplicate_reason"], r["duplicate_of"]) for r in done}


def test_a_nested_region_of_the_same_role_goes(spark):
    got = settled(spark, [region("inner", "handwritten_data", (10, 10, 30, 30), utility=40), region("outer", "annotation_label", (0, 0, 100, 100), utility=90)])
    assert got == {"outer": ("", ""), "inner": ("same_role_geometry_duplicate", "outer")}


def test_identifier_parent_and_child_stay(spark):
    got = settled(spark, [region("database", "database_label", (0, 0, 200, 100), utility=80), region("number", "number", (20, 20, 80, 50), text="L.2714152", utility=70)])
    assert got == {"database": ("", ""), "number": ("", "")}


def test_a_label_and_another_role_stay(spark):
    got = settled(spark, [region("a", "primary_specimen_label", (0, 0, 100, 100), utility=80), region("b", "stamp", (0, 0, 100, 100), utility=70)])
    assert set(got.values()) == {("", "")}


def test_masks_alone_make_a_duplicate(spark):
    left = region("left", "annotation_label", (0, 0, 100, 100), utility=90)
    right = region("right", "handwritten_data", (100, 0, 200, 100), utility=80, overlaps={"left": 0.8})
    assert settled(spark, [left, right])["right"] == ("same_role_geometry_duplicate", "left")
    weak = region("right", "handwritten_data", (100, 0, 200, 100), utility=80, overlaps={"left": 0.4})
    assert settled(spark, [left, weak])["right"] == ("", "")
    other_way = region("left", "annotation_label", (0, 0, 100, 100), utility=90, overlaps={"right": 0.5})
    assert settled(spark, [other_way, region("right", "stamp", (100, 0, 200, 100), utility=80)])["right"][0] == "same_role_geometry_duplicate"


def test_texts_across_roles(spark):
    parent = region("a", "database_label", (0, 0, 100, 100), utility=90, text="Herbarium of Kew 1921")
    same = region("b", "stamp", (0, 0, 100, 60), utility=80, text="herbarium of kew, 1921")
    assert settled(spark, [parent, same])["b"] == ("same_text_cross_class_duplicate", "a")
    other = region("b", "stamp", (0, 0, 100, 60), utility=80, text="something else here")
    assert settled(spark, [parent, other])["b"] == ("", "")
    one_place = region("b", "stamp", (0, 0, 100, 99), utility=80, text="something else here")
    assert settled(spark, [parent, one_place])["b"] == ("high_iou_class_conflict", "a")
    decoded = region("b", "stamp", (0, 0, 100, 60), utility=80, text="x", decoded="Herbarium of Kew 1921")
    assert settled(spark, [parent, decoded])["b"][0] == "same_text_cross_class_duplicate"


def test_who_went_hides_nobody(spark):
    """b goes for a; c overlaps only b, so c stays."""
    rows = [region("a", "stamp", (0, 0, 100, 10), utility=90), region("b", "stamp", (40, 0, 140, 10), utility=80), region("c", "stamp", (85, 0, 185, 10), utility=70)]
    rows[0] = region("a", "stamp", (0, 0, 100, 10), utility=90, overlaps={"b": 0.5})
    rows[2] = region("c", "stamp", (85, 0, 185, 10), utility=70, overlaps={"b": 0.5})
    assert settled(spark, rows) == {"a": ("", ""), "b": ("same_role_geometry_duplicate", "a"), "c": ("", "")}


def test_roles_are_mixed_up_to_the_limit(spark):
    rows = [
        region("primary", "primary_specimen_label", (0, 0, 200, 100), utility=100), region("database", "database_label", (0, 100, 100, 150), utility=95), region("number", "number", (20, 110, 80, 140), utility=90),
        region("annotation", "annotation_label", (0, 160, 100, 220), utility=85), region("number2", "number", (120, 110, 180, 140), utility=80), region("low", "number", (0, 0, 50, 20), confidence=0.04, text="", utility=99), region("none", "ruler", (0, 0, 5, 5)),
    ]
    done = {r["id"]: r for r in crops.choose(spark.createDataFrame(rows, SCHEMA), "b", False, total=4).collect()}
    assert {k for k, r in done.items() if r["selection_status"] == "selected"} == {"primary", "database", "number", "annotation"}
    assert [done[k]["input_order"] for k in ("primary", "number", "database", "annotation")] == [1, 2, 3, 4]
    assert done["number2"]["selection_status"] == "rejected_quota" and done["number2"]["selection_reason"] == "role_or_total_quota"
    assert done["low"]["selection_reason"] == "below_class_threshold" and done["none"]["selection_reason"] == "unsupported_component_type"
    nothing = crops.choose(spark.createDataFrame(rows[:1], SCHEMA), "b", True, total=0).collect()
    assert [r["selection_status"] for r in nothing] == ["rejected_quota"]


def test_gate_of_empty_regions(spark):
    rows = [region("number", "number", (0, 0, 50, 20), confidence=0.09, text=""), region("hand", "handwritten_data", (0, 0, 100, 30), confidence=0.45, text="")]
    done = {r["id"]: r for r in crops.choose(spark.createDataFrame(rows, SCHEMA), "b", False).collect()}
    assert done["number"]["gate"] == "empty_evidence" and done["hand"]["gate"] == "vision_only_high_confidence"


def test_equal_regions_have_one_order(spark):
    """Regions alike in utility, id, box and texts are told apart by confidence and masks, in whatever order they are read."""
    rows = [region("x", "stamp", (0, 0, 10, 10), confidence=c, overlaps=o) for c, o in ((0.5, {"y": 0.9}), (0.5, None), (0.5, {"y": 0.1}), (0.3, {"y": 0.2}))]
    runs = []
    for order in (rows, rows[::-1]):
        done = crops.deduplicated(spark.createDataFrame(order, SCHEMA).coalesce(1)).collect()
        runs.append(sorted((r["place"], r["confidence"], str(r["overlaps"])) for r in done))
    assert runs[0] == runs[1]


def test_regions_are_dealt_once(spark):
    """Below the deal by record only what is narrow is exchanged: no texts or masks of regions, and no joins by more than the record."""
    with contextlib.redirect_stdout(out := io.StringIO()):
        catalog.queries()["crop_field_summary"](spark, "/root/testdata/sf0.001").explain()
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", out.getvalue())
    assert 1 <= sum(e.startswith("l_orderkey") for e in exchanges) <= 2 and len(exchanges) <= 8, exchanges
    assert "decisions-" not in out.getvalue()  # nothing of them is written


def test_tables(spark):
    rows = [region("database", "database_label", (0, 0, 200, 100)), region("number", "number", (10, 10, 70, 40), text="L.2714152", utility=49.0), region("number_dup", "number", (11, 11, 71, 41), text="L.2714152", utility=48.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    decisions = crops.choose(df, "plain", False).unionByName(crops.choose(df, "single", True))
    refs = spark.createDataFrame([(1, "L 2714152", "Rosa", None), (2, "", "", "")], "record long, catalogNumber string, country string, eventDate string")
    made = crops.tables(decisions, refs, ["catalogNumber", "country", "eventDate"])
    records = {(r["branch"], r["record"]): r for r in made["records"].collect()}
    assert records["plain", 1]["selected_duplicate_pair_count"] == 1 and records["single", 1]["selected_duplicate_pair_count"] == 0
    assert records["plain", 1]["unique_text_count"] == 2 and records["plain", 1]["ocr_usable_crop_count"] == 3
    assert records["single", 1]["field_evidence_hit_rate"] == 0.5 and records["single", 1]["catalog_number_evidence_hit"]
    assert records["plain", 2]["candidate_count"] == 0 and records["plain", 2]["field_evidence_hit_rate"] == 0.0
    branches = {r["branch"]: r for r in made["branches"].collect()}
    assert branches["single"]["dedup_rejection_count"] == 1 and branches["plain"]["dedup_rejection_count"] == 0 and branches["plain"]["records_without_input"] == 1
    assert made["fields"].count() == 12
    summary = {(r["branch"], r["field"]): r["evidence_hit_rate"] for r in made["field_summary"].collect()}
    assert summary["plain", "catalogNumber"] == 1.0 and summary["plain", "country"] == 0.0 and summary["plain", "eventDate"] == 0.0


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ([], [], (0, 0, 0)), (None, [(0, 5)], (0, 5, 0)), ([(0, 10)], [(5, 15)], (10, 10, 5)), ([(0, 10), (20, 30)], [(8, 22)], (20, 14, 4)),  # a hole
        ([(20, 30), (0, 10)], [(10, 20)], (20, 10, 0)), ([(0, 10), (5, 12)], [(0, 12)], (12, 12, 12)), ([(7, 7), (9, 3)], [(0, 20)], (0, 20, 0)),  # touching, overlapping, empty runs
    ],
)
def test_masks(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<struct<start:bigint,stop:bigint>>, b array<struct<start:bigint,stop:bigint>>")
    shares = geometry.mask_shares(F.col("a"), F.col("b"))
    r = df.select(shares.alias("s"), geometry.mask_iou(shares).alias("iou"), geometry.mask_containment(shares).alias("inside")).first()
    assert tuple(r["s"]) == want
    union, smaller = want[0] + want[1] - want[2], min(want[:2])
    assert r["iou"] == (want[2] / union if union else 0.0) and r["inside"] == (want[2] / smaller if smaller else 0.0)


@pytest.mark.parametrize("few", [0, 256])
def test_shares_of_runs(spark, few):
    """Runs put in order once a mask give what the sweep over both masks gives, whichever way few and many runs are met."""
    masks = [[], None, [(0, 10), (5, 12), (20, 22)], [(20, 30), (0, 10)], [(7, 7), (9, 3), (8, 21)], [(12, 20), (0, 12)]]
    df = spark.createDataFrame([(a, b) for a in masks for b in masks], "a array<struct<start:bigint,stop:bigint>>, b array<struct<start:bigint,stop:bigint>>")
    runs = df.select("a", "b", geometry.mask_runs(F.col("a")).alias("x"), geometry.mask_runs(F.col("b")).alias("y"))
    got = runs.select(geometry.mask_shares(F.col("a"), F.col("b")).alias("want"), geometry.run_shares(F.col("x"), F.col("y"), geometry.run_pixels(F.col("x")), geometry.run_pixels(F.col("y")), few).alias("got"), "x").collect()
    assert all(tuple(r["got"]) == tuple(r["want"]) for r in got)
    assert {len(r["x"]) for r in got} == {0, 1, 2}


def test_shares_are_computed_once_a_pair(spark):
    with contextlib.redirect_stdout(out := io.StringIO()):
        catalog.queries()["mask_overlap"](spark, "/root/testdata/sf0.001").explain()
    assert not re.search(r"(Filter|Join)[^\n]*aggregate\(", out.getvalue())


def test_overlap_maps(spark):
    rows = [('{"a": 0.5, "b": null, "c": "x"}',), ("[1]",), ("no json",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(geometry.overlap_map(F.col("c"))).collect()]
    assert got[0] == {"a": 0.5, "b": 0.0, "c": 0.0} and all(g == {} for g in got[1:])
