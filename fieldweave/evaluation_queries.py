"""The evaluation of predicted fields against gold and evidence, as registered queries with oracle SQL.

Two methods read a sheet of each order: its number, date, clerk and latitude, with spans, confidences and warnings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import text as T
from .operators import evaluate, splits
from .operators.review import HIGH_RISK
from .registry import Register
from .sinks.places import new_path
from .sources.files import dealt, table

register = Register()

NAMES = ["catalogNumber", "eventDate", "recordedBy", "decimalLatitude"]
# Expressions that Spark and DuckDB both read; {ymd}, {dmy} stand for the order's date in two forms.
_K, _NO = "o_orderkey", "lpad(CAST(o_orderkey AS VARCHAR(20)), 8, '0')"
_GOLD = {
    "catalogNumber": f"'E' || {_NO}",
    "eventDate": f"CASE WHEN {_K} % 19 = 0 THEN '' ELSE {{ymd}} END",
    "recordedBy": f"'Clerk ' || ({_K} % 1000)",
    "decimalLatitude": f"({_K} % 90) || '.5'",
}
_READ = {
    "rule": {
        "catalogNumber": f"CASE WHEN {_K} % 7 = 0 THEN '' ELSE 'E ' || {_NO} END",
        "eventDate": f"CASE WHEN {_K} % 3 = 0 THEN {{dmy}} ELSE {{ymd}} END",
        "recordedBy": f"'clerk ' || ({_K} % 1000)",
        "decimalLatitude": f"({_K} % 90) || '.50004'",
    },
    "model": {
        "catalogNumber": f"'E-' || {_NO} || CASE WHEN {_K} % 11 = 0 THEN '1' ELSE '' END",
        "eventDate": "substr({ymd}, 1, 4)",
        "recordedBy": f"({_K} % 1000) || ', Clerk'",
        "decimalLatitude": f"CASE WHEN {_K} % 5 = 0 THEN 'north' ELSE ({_K} % 90) || '.6' END",
    },
}
_TEXT = f"CASE WHEN {_K} % 4 = 0 THEN '' ELSE 'Sheet E' || {_NO} || ' by Clerk ' || ({_K} % 1000) || ' on ' || {{ymd}} END"
_SURE = {"catalogNumber": f"({_K} % 11) / 10.0", "eventDate": "0.95", "recordedBy": f"CASE WHEN {_K} % 6 = 0 THEN NULL ELSE 0.8 END", "decimalLatitude": f"({_K} % 5) / 4.0"}


def _span(method: str, field: str, said: str, gold: str) -> str:
    return said if method == "rule" else f"CASE WHEN {_K} % 2 = 0 THEN {gold} ELSE '' END"


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    said = lambda x: F.expr(x.format(ymd="date_format(o_orderdate, 'yyyy-MM-dd')", dmy="date_format(o_orderdate, 'd/M/yyyy')"))
    orders = dealt(table(spark, sf, "orders"), _K)
    parts = []
    for method, read in _READ.items():
        spans = F.struct(*(said(_span(method, f, read[f], _GOLD[f])).alias(f) for f in NAMES))
        parts.append(F.struct(F.lit(method).alias("method"), *(said(read[f]).alias(f) for f in NAMES), spans.alias("spans"), F.struct(*(said(_SURE[f]).cast("double").alias(f) for f in NAMES)).alias("confidences"), (F.col(_K) % 13 == 0).alias("warning"), F.lit(method == "model").__and__(F.col(_K) % 17 == 0).alias("not_evaluated")))
    predicted = orders.select(_K, F.inline(F.array(*parts)))
    gold = orders.select(_K, *(said(_GOLD[f]).alias(f) for f in NAMES))
    own, other = said(_GOLD["catalogNumber"]), F.concat(said(_GOLD["catalogNumber"]), F.lit("9"))
    few = lambda n: F.when(F.col(_K) % n == 0, F.array(own)).when(F.col(_K) % n == 1, F.array(own, other)).when(F.col(_K) % n == 2, F.array(other))
    return predicted, gold, orders.select(_K, said(_TEXT).alias("evidence_text"), few(10).alias("barcodes"), few(9).alias("readings"))


def _detail_sql() -> str:
    said = lambda x: x.format(ymd="strftime(o_orderdate, '%Y-%m-%d')", dmy="strftime(o_orderdate, '%-d/%-m/%Y')")
    rows = " UNION ALL ".join(
        f"SELECT o_orderkey, '{m}' AS method, '{f}' AS field, {said(read[f])} AS pred, {said(_GOLD[f])} AS gold, {said(_span(m, f, read[f], _GOLD[f]))} AS span, {said(_TEXT)} AS ev, CAST({_SURE[f]} AS DOUBLE) AS c, o_orderkey % 13 = 0 AS w, {'o_orderkey % 17 = 0' if m == 'model' else 'false'} AS skip FROM orders"
        for m, read in _READ.items() for f in NAMES
    )
    own = said(_GOLD["catalogNumber"])
    return f"""WITH r AS ({rows}),
      n AS (SELECT *, {S.normal_value('field', 'pred')} AS p, {S.normal_value('field', 'gold')} AS g, {S.normal_value('field', 'span')} AS s, {S.normal('ev')} AS e, {S.normal('pred')} AS pn, {S.normal('span')} AS sn, pred <> '' AND NOT skip AS predicted, gold <> '' AND NOT skip AS has_gold FROM r),
      x AS (SELECT *, {S.exact('field', 'pred', 'gold', 'p', 'g')} AS exact, {S.proxy('pn', 'e')} AS support, {S.proxy('sn', 'e')} AS span_support,
        CASE WHEN pred <> '' AND span <> '' THEN CASE WHEN field IN ('catalogNumber', 'decimalLatitude') THEN CAST({S.exact('field', 'pred', 'span', 'p', 's')} AS DOUBLE) ELSE {S.bag_f1(S.bag('p'), S.bag('s'))} END END AS aligned FROM n),
      t AS (SELECT *, field IN ({S.listed(list(HIGH_RISK))}) AS risky, CASE WHEN NOT predicted THEN 'not_predicted' WHEN span_support >= 1 AND aligned >= 0.5 THEN 'direct' WHEN span_support >= 0.5 AND aligned >= 0.5 THEN 'partial_direct'
        WHEN support >= 1 THEN 'prediction_in_ocr' WHEN span_support >= 1 THEN 'contextual_inference' ELSE 'unsupported' END AS status FROM x),
      q AS (SELECT t.*, {own} AS own, field = 'catalogNumber' AND predicted AS named, t.o_orderkey % 10 AS b, t.o_orderkey % 9 AS h,
        concat_ws(';', CASE WHEN status <> 'direct' THEN 'support:' || status END, CASE WHEN c IS NULL THEN 'confidence:missing' WHEN c < 0.75 THEN 'confidence_below:0.75' END, CASE WHEN risky AND status <> 'direct' THEN 'high_risk_without_direct_evidence' END,
          CASE WHEN risky AND (c IS NULL OR c < 0.9) THEN 'high_risk_confidence_below:0.9' END, CASE WHEN w THEN 'schema_validation_warning' END) AS why FROM t),
      k AS (SELECT *, named AND b = 1 AS b2, named AND (b = 0 AND p <> own OR b = 2 AND p <> own || '9') AS b1, named AND h = 1 AS h2, named AND (h = 0 AND p <> own OR h = 1 AND p NOT IN (own, own || '9') OR h = 2 AND p <> own || '9') AS h1,
        why <> '' AND (status = 'unsupported' OR risky AND status <> 'direct' OR coalesce(c < 0.5, false)) AS urgent FROM q),
      detail AS (SELECT o_orderkey, method, field, pred AS prediction, gold, p AS normalised_prediction, g AS normalised_gold, CAST(has_gold AS INT) AS evaluable, CASE WHEN has_gold THEN CAST(pred <> '' AS INT) END AS coverage, CASE WHEN has_gold THEN exact END AS exact_match,
        CASE WHEN has_gold THEN CASE WHEN field IN ('catalogNumber', 'decimalLatitude') THEN CAST(exact AS DOUBLE) ELSE {S.bag_f1(S.bag('p'), S.bag('g'))} END END AS token_f1, CASE WHEN predicted THEN CAST(span <> '' AS INT) END AS span_present, CASE WHEN predicted THEN support END AS support, status,
        CASE WHEN predicted THEN CAST(status = 'direct' AS INT) END AS direct, CASE WHEN predicted THEN CAST(status <> 'direct' AS INT) END AS unsupported, CASE WHEN predicted THEN CAST(why <> '' OR b1 OR b2 OR h1 OR h2 AS INT) END AS review_required,
        CASE WHEN NOT predicted THEN '' WHEN urgent OR b1 OR b2 OR h1 THEN 'high' WHEN why <> '' OR h2 THEN 'medium' ELSE '' END AS review_priority,
        CASE WHEN predicted THEN concat_ws(';', nullif(why, ''), CASE WHEN b2 THEN 'multiple_decoded_barcodes' END, CASE WHEN b1 THEN 'catalog_mismatch_single_decoded_barcode' END, CASE WHEN h2 THEN 'multiple_catalog_ocr_hypotheses' END, CASE WHEN h1 THEN 'catalog_mismatch_ocr_ensemble' END) ELSE '' END AS review_reasons,
        CAST(w AS INT) AS warning, CAST(skip AS INT) AS not_evaluated, c AS confidence FROM k)"""


_DETAIL = _detail_sql()
_MEANS = ", ".join(f"round(avg({c}), 6) AS {name}" for name, c in evaluate.MEANS.items()) + ", CAST(sum(evaluable) AS BIGINT) AS n"


def _detail(spark: SparkSession, sf: str) -> DataFrame:
    predicted, gold, evidence = _inputs(spark, sf)
    return evaluate.fields(predicted, gold, evidence, NAMES, _K)


@register.add(_DETAIL + " SELECT * REPLACE (round(token_f1, 6) AS token_f1, round(support, 6) AS support) FROM detail")
def eval_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Every record, method and field: scores, support, review with overlays of barcodes and readings."""
    return _detail(spark, sf).withColumns({"token_f1": F.round("token_f1", 6), "support": F.round("support", 6)})


@register.add(_DETAIL + f" SELECT method, field, {_MEANS} FROM detail GROUP BY 1, 2")
def eval_field_summary(spark: SparkSession, sf: str) -> DataFrame:
    """All means by method and field."""
    return evaluate.field_summary(_detail(spark, sf), "method", "field")


@register.add(_DETAIL + f" SELECT field, {_MEANS} FROM detail WHERE method = 'model' AND field IN ('catalogNumber', 'recordedBy') GROUP BY 1")
def eval_one_method(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of one method and single fields."""
    return evaluate.field_summary(_detail(spark, sf).filter("method = 'model'").filter(F.col("field").isin("catalogNumber", "recordedBy")), "field")


@register.add(_DETAIL + " SELECT o_orderkey, method, field, status, review_priority, review_reasons FROM detail WHERE review_required = 1")
def eval_review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """What a person should look at (K1's review queue)."""
    asked = F.when(F.col("review_required") == 1, F.array(F.struct(_K, "method", "field", "status", "review_priority", "review_reasons")))
    return _detail(spark, sf).select(F.inline(asked))  # a filter would be pushed below and compute every score twice


_PROXY = f"""proxies AS (SELECT o_orderkey, avg(v) AS score FROM (SELECT o_orderkey, {S.proxy(S.normal('gold'), S.normal('ev'))} AS v FROM r WHERE method = 'rule') GROUP BY 1),
    ranks AS (SELECT o_orderkey, coalesce(score, 0) AS score FROM proxies), cuts AS (SELECT quantile_cont(score, [0.3333333333333333, 0.6666666666666666, 0.5]) AS q, min(score) AS lo, max(score) AS hi, count(DISTINCT score) AS many, count(*) AS n FROM ranks),
    thirds AS (SELECT o_orderkey, CASE WHEN many < 3 THEN CASE WHEN score >= q[3] THEN 'high' ELSE 'low' END
      WHEN q[1] = lo OR q[1] = q[2] OR q[2] = hi THEN CASE WHEN 3 * row_number() OVER (ORDER BY score, o_orderkey) <= n THEN 'low' WHEN 3 * row_number() OVER (ORDER BY score, o_orderkey) <= 2 * n THEN 'medium' ELSE 'high' END
      WHEN score <= q[1] THEN 'low' WHEN score <= q[2] THEN 'medium' ELSE 'high' END AS tertile FROM ranks, cuts)"""


@register.add(_DETAIL + f", {_PROXY} SELECT method, tertile, field, round(avg(exact_match), 6) AS exact_match, round(avg(token_f1), 6) AS token_f1, round(avg(coverage), 6) AS coverage, count(DISTINCT o_orderkey) AS n_records FROM detail JOIN thirds USING (o_orderkey) GROUP BY 1, 2, 3")
def eval_by_tertile(spark: SparkSession, sf: str) -> DataFrame:
    """Means by method, tertile of the evidence and field, with the number of records."""
    _, gold, evidence = _inputs(spark, sf)
    held = evaluate.prepared(gold.join(evidence.hint("merge"), _K))
    known = held.select(_K, F.inline(F.array(*(F.struct(evaluate.proxy(T.normalize_eval(F.col(f))).alias("v")) for f in NAMES))))
    # Written once: the edges of the thirds take several passes over the scores.
    path = new_path(spark, "scores")
    known.groupBy(_K).agg(F.avg("v").alias("score")).write.parquet(path)
    thirds = splits.tertiles(spark.read.parquet(path), "score", key=_K).select(_K, "tertile")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return _detail(spark, sf).join(thirds.hint("merge"), _K).groupBy("method", "tertile", "field").agg(mean("exact_match"), mean("token_f1"), mean("coverage"), F.count_distinct(_K).alias("n_records"))


@register.add(_DETAIL + f", {_PROXY.split(',' + chr(10))[0].replace('proxies AS (SELECT o_orderkey, avg(v) AS score FROM (SELECT o_orderkey,', 'f AS (SELECT field,').replace(') GROUP BY 1)', ')')} SELECT field, round(avg(v), 6) AS proxy, count(v) AS n FROM f GROUP BY 1")
def proxy_by_field(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and number of evidence scores of gold values, by field."""
    _, gold, evidence = _inputs(spark, sf)
    held = evaluate.prepared(gold.join(evidence.hint("merge"), _K))
    known = held.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), evaluate.proxy(T.normalize_eval(F.col(f))).alias("v")) for f in NAMES))))
    return known.groupBy("field").agg(F.round(F.avg("v"), 6).alias("proxy"), F.count("v").alias("n"))
