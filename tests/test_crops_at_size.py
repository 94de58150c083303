"""What lets the choice of regions run over many records: compiled methods, and pairs of regions judged once."""

import re

import pytest
from test_crops import SCHEMA, region

from fieldweave import catalog
from fieldweave.operators import crops


@pytest.mark.parametrize("name", ["deduplicated_regions", "crop_branches", "crop_field_summary", "crop_records"])
def test_methods_are_short_enough_to_be_compiled(spark, name):
    """The JVM never compiles a method of 8,000 bytes or more; rows would be interpreted."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$").codegenString(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", code)]
    assert sizes and 0 < min(sizes) and max(sizes) < 8000, sizes


def test_pairs_judged_once_count_as_those_of_the_packets(spark):
    """Pairs that choose_each() hands on give the tables that comparing the chosen regions again gives, in the packet's order."""
    rows = [
        region("a", "database_label", (0, 0, 100, 100), utility=90, text="abcd efgh ij"), region("b", "stamp", (0, 0, 100, 60), utility=95, text="abcd efgh i"), region("c", "stamp", (0, 0, 100, 58), utility=80, text="x"),
        region("d", "number", (300, 0, 320, 20), utility=70, text="E1", overlaps={"e": 0.9}), region("e", "number", (400, 0, 420, 20), utility=60, text="E2"), region("f", "number", (0, 0, 5, 5), text="", confidence=0.01),
        region("a", "stamp", (0, 0, 10, 10), record=2), region("b", "stamp", (5, 0, 15, 10), record=2), region("c", "ruler", (0, 0, 9, 9), record=2),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    refs = spark.createDataFrame([(1, "E1", "x"), (2, "", "visible"), (3, "E1", "")], "record long, catalogNumber string, country string")
    branches = {"plain": False, "single": True}
    tables = [crops.tables(crops.choose_each(df, branches, with_pairs=p), refs, ["catalogNumber", "country"], list(branches)) for p in (True, False)]
    got = [{k: sorted(map(tuple, t[k].collect())) for k in ("records", "branches", "field_summary")} for t in tables]
    assert got[0] == got[1]
    counts = {(r["branch"], r["record"]): r["selected_duplicate_pair_count"] for r in tables[0]["records"].collect()}
    assert counts["plain", 1] == 3 and counts["single", 1] == 0 and counts["plain", 3] == 0
