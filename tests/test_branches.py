"""Records of a comparison are joined once and scored by the rules of their own fields."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from fieldweave import catalog
from fieldweave.functions import fields as R
from fieldweave.functions import text as T
from fieldweave.operators import comparisons

SF = "/root/testdata/sf0.001"


def plan(frame):
    with contextlib.redirect_stdout(out := io.StringIO()):
        frame.explain()
    return out.getvalue()


def test_records_are_joined_before_they_become_rows(spark):
    for name in ("branch_fields", "branch_table", "overall_summary"):
        text = plan(catalog.queries()[name](spark, SF))
        assert not re.search(r"Exchange hashpartitioning\(record#\d+L?, field#", text), name
        assert "array_sort(" not in text, name


def test_bags_are_made_once_a_pair(spark):
    text = plan(spark.createDataFrame([("a b", "b c")], "p string, g string").select(R.f1_of(F.lit("country"), F.lit(0), F.col("p"), F.col("g"))))
    assert text.count("split(") <= 4


def test_scores_of_odd_values(spark):
    fields = ["catalogNumber", "recordedBy", "eventDate", "decimalLatitude"]
    said = [(1, "a", " e-1 ", "B. Mora A", "3 Mar 1921/1922", "12.50", "no", None, "1", "x"), (2, "b", None, "x x y", "1921 ", "nan", None, None, None, None), (None, "b", "E1", "A", "1921", "1", None, None, None, None)]
    gold = [(1, "E1", "Mora, A B", "1921-03-03/1922", "12.50001"), (2, "E2", "x y y", "1921", "7"), (2, " NULL ", None, "\t1921-03", ""), (None, "E1", "A", "1921", "1")]
    predicted = spark.createDataFrame(said, "record long, branch string, " + ", ".join(f"{f} string" for f in fields) + ", " + ", ".join(f"{f}_review_required string" for f in fields))
    truth = spark.createDataFrame(gold, "record long, " + ", ".join(f"{f} string" for f in fields))
    got = comparisons.branch_detail(predicted, truth, fields).collect()
    rows = sorted((r["record"], r["field"], r["gold"], r["coverage"], r["exact_match"], round(r["token_f1"], 6), r["review_required"]) for r in got)
    assert rows == sorted([
        (1, "catalogNumber", "E1", 1.0, 1, 1.0, False), (1, "recordedBy", "Mora, A B", 1.0, 1, 1.0, False), (1, "eventDate", "1921-03-03/1922", 1.0, 1, 1.0, True), (1, "decimalLatitude", "12.50001", 1.0, 1, 1.0, True),
        (2, "catalogNumber", "E2", 0.0, 0, 0.0, False), (2, "recordedBy", "x y y", 1.0, 0, 0.666667, False), (2, "eventDate", "1921", 1.0, 0, 0.0, False), (2, "decimalLatitude", "7", 0.0, 0, 0.0, False), (2, "eventDate", "1921-03", 1.0, 0, 0.0, False),
    ])
    years = spark.createDataFrame([("1921",), ("1921-03",), ("",), ("1921-13",), (" 1921/1922 ",)], "c string").select(T.event_date(F.col("c"))).collect()
    assert [r[0] for r in years] == ["1921", "1921-03", "", "1921-13", "1921/1922"]
