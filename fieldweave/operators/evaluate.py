"""Field-level evaluation: long detail rows and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as R
from ..functions import text as T
from . import review


def prepared(rows: DataFrame, text: str = "evidence_text") -> DataFrame:
    """Adds the normal form of the evidence and its words, once for every method and field that is held against it."""
    normal = rows.withColumn("evidence_normal", T.normalize_eval(F.col(text)))
    return normal.withColumn("evidence_words", F.array_distinct(F.split("evidence_normal", " ")))


def proxy(value: Column) -> Column:
    """Of a normal form: null if blank, 1 if the evidence holds it, else the share of its distinct words that the evidence has."""
    own = F.array_distinct(R.bag(value))
    share = F.size(F.array_intersect(own, "evidence_words")) / F.size(own)
    return F.when(value == "", None).when(F.col("evidence_normal") == "", 0.0).when(F.contains("evidence_normal", value), 1.0).otherwise(share)


def detail(rows: DataFrame) -> DataFrame:
    """Adds filled, evaluable, coverage, exact_match, token_f1 and evidence to prepared() rows of (method, pred, gold).

    Scores are null, not zero, where there is no gold value to hold them against. Each value is normalised once.
    """
    normal = rows.select("*", T.normalize_eval(F.col("pred")).alias("p"), T.normalize_eval(F.col("gold")).alias("g"), (T.clean(F.col("gold")) != "").alias("has_gold"), (T.clean(F.col("pred")) != "").cast("int").alias("filled"))
    split = normal.select("*", R.bag(F.col("p")).alias("pw"), R.bag(F.col("g")).alias("gw"))
    score = lambda c: F.when(F.col("has_gold"), c)
    return split.select(
        *rows.columns,
        "filled",
        F.col("has_gold").cast("int").alias("evaluable"),
        score(F.col("filled")).alias("coverage"),
        score((F.col("p") == F.col("g")).cast("int")).alias("exact_match"),
        score(R.bag_f1(F.col("pw"), F.col("gw"))).alias("token_f1"),
        proxy(F.col("p")).alias("evidence"),
    )


def fields(predicted: DataFrame, gold: DataFrame, evidence: DataFrame, names: list[str], record: str) -> DataFrame:
    """The whole evaluation: one row a record, method and field, with scores, evidence support and review decision.

    `predicted` has record, method, the fields, struct columns `spans` and `confidences` by field, warning (boolean) and
    not_evaluated (boolean); `gold` has record and the fields; `evidence` has record, evidence_text, and the arrays
    barcodes and readings of identifiers seen. Records without gold are left out. All three grow alike, so none is broadcast.
    """
    keys = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: T.identifier_key(x))).alias(f"{c}_keys")
    known_of = gold.select(record, F.struct(*names).alias("gold_of")).join(evidence.hint("merge"), record, "left")
    # Identifiers seen are put in their normal form once a record, not once a method and field.
    known_of = known_of.select("*", F.coalesce(F.size("barcodes"), F.lit(0)).alias("codes"), keys("barcodes"), keys("readings"))
    held = predicted.join(prepared(known_of).hint("merge"), record)
    one = lambda f: F.struct(F.lit(f).alias("field"), T.clean(F.col(f)).alias("pred"), T.clean(F.col(f"gold_of.{f}")).alias("gold"), T.clean(F.col(f"spans.{f}")).alias("span"), F.col(f"confidences.{f}").alias("confidence"))
    rows = held.select(record, "method", "warning", "not_evaluated", "codes", "barcodes_keys", "readings_keys", "evidence_normal", "evidence_words", F.inline(F.array(*map(one, names))))
    f, pred, gold_, span = F.col("field"), F.col("pred"), F.col("gold"), F.col("span")
    known = F.coalesce(F.col("not_evaluated"), F.lit(False))
    # The three values go through one expression: three copies of it are more code than the JVM will compile.
    forms = F.transform(F.array(pred, gold_, span), lambda v: R.normal_value(f, v))
    plain = F.transform(F.array(pred, span), lambda v: T.normalize_eval(v))
    rows = rows.withColumns({"forms": forms, "plain": plain, "predicted": (pred != "") & ~known, "has_gold": (gold_ != "") & ~known})
    rows = rows.withColumns({c: F.get(of, F.lit(i)) for c, of, i in (("p", "forms", 0), ("g", "forms", 1), ("s", "forms", 2), ("pn", "plain", 0), ("sn", "plain", 1))})
    p, g, s = F.col("p"), F.col("g"), F.col("s")
    rows = rows.withColumns({"exact": R.exact_of(f, pred, gold_, p, g), "support": proxy(F.col("pn")), "span_support": proxy(F.col("sn")), "aligned": F.when((pred != "") & (span != ""), R.f1_of(f, R.exact_of(f, pred, span, p, s), p, s))})
    rows = rows.withColumns({"status": review.support_status(F.col("predicted"), F.col("span_support"), F.col("aligned"), F.col("support"))})
    rows = rows.withColumn("d", review.decide(f, F.col("status"), F.col("confidence"), F.col("warning")))
    # The normal form of a catalog number is its key.
    named, codes, read = (f == "catalogNumber") & F.col("predicted"), F.col("codes"), F.col("readings_keys")
    many_codes, other_code = named & (codes > 1), named & (codes == 1) & ~F.array_contains("barcodes_keys", p)
    many_read, other_read = named & (F.size(read) > 1), named & (F.size(read) > 0) & ~F.array_contains(read, p)
    reasons = F.concat_ws(";", F.nullif(F.col("d.reasons"), F.lit("")), F.when(many_codes, "multiple_decoded_barcodes"), F.when(other_code, "catalog_mismatch_single_decoded_barcode"), F.when(many_read, "multiple_catalog_ocr_hypotheses"), F.when(other_read, "catalog_mismatch_ocr_ensemble"))
    asked = F.col("d.review") | many_codes | other_code | many_read | other_read
    priority = F.when((F.col("d.review") & (F.col("d.priority") == "high")) | many_codes | other_code | other_read, "high").when(asked, "medium").otherwise("")
    score, on = lambda c: F.when(F.col("has_gold"), c), F.col("predicted")
    f1 = R.f1_of(f, F.col("exact"), p, g)
    return rows.select(
        record, "method", "field", pred.alias("prediction"), "gold", F.col("p").alias("normalised_prediction"), F.col("g").alias("normalised_gold"), F.col("has_gold").cast("int").alias("evaluable"),
        score((pred != "").cast("int")).alias("coverage"), score(F.col("exact")).alias("exact_match"), score(f1).alias("token_f1"), F.when(on, (span != "").cast("int")).alias("span_present"),
        F.when(on, F.col("support")).alias("support"), "status", F.when(on, (F.col("status") == "direct").cast("int")).alias("direct"), F.when(on, (F.col("status") != "direct").cast("int")).alias("unsupported"),
        F.when(on, asked.cast("int")).alias("review_required"), F.when(on, priority).otherwise("").alias("review_priority"), F.when(on, reasons).otherwise("").alias("review_reasons"),
        F.col("warning").cast("int").alias("warning"), known.cast("int").alias("not_evaluated"), "confidence",
    )


#: Means of an evaluation: name of the mean, column.
MEANS = {
    "coverage": "coverage", "exact_match": "exact_match", "token_f1": "token_f1", "warning_rate": "warning", "not_evaluated_rate": "not_evaluated", "span_present_rate": "span_present",
    "direct_rate": "direct", "unsupported_rate": "unsupported", "review_rate": "review_required", "mean_support": "support",
}


def field_summary(detailed: DataFrame, *keys: str) -> DataFrame:
    """All means of fields() by keys, and the number of rows that could be judged."""
    return detailed.groupBy(*keys).agg(*(F.round(F.avg(c), 6).alias(name) for name, c in MEANS.items()), F.sum("evaluable").cast("long").alias("n"))


def summary(detailed: DataFrame, *keys: str) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return detailed.groupBy(*keys).agg(mean("coverage"), mean("exact_match"), mean("token_f1"), mean("evidence"), F.sum("evaluable").cast("long").alias("n"))


def deltas(detailed: DataFrame, baseline: str, candidate: str, *keys: str) -> DataFrame:
    """Means of the candidate method less those of the baseline, by key, in one pass."""
    scores = ("coverage", "exact_match", "token_f1", "evidence")
    mean = lambda c, m: F.avg(F.when(F.col("method") == m, F.col(c)))
    return detailed.groupBy(*keys).agg(*[F.round(mean(c, candidate) - mean(c, baseline), 6).alias(f"{c}_delta") for c in scores])
