"""Registered queries on comparisons of methods and branches, and on models' answers, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import answers, similarity
from .functions import fields as R
from .functions import text as T
from .operators import comparisons
from .registry import Register
from .sources.files import table

register = Register()

_FIELDS = ["catalogNumber", "country", "recordedBy", "eventDate"]
_GOLD = {
    "catalogNumber": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'E' || CAST(100000 + o_orderkey AS STRING) END", "country": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Cuba' ELSE 'United Kingdom' END",
    "recordedBy": "CASE o_orderkey % 3 WHEN 0 THEN 'K. I. Lahtivirta' ELSE 'A. Mora' END", "eventDate": "CASE o_orderkey % 5 WHEN 0 THEN '1921-03-03' ELSE '1921' END",
}
_PRED = {
    "catalogNumber": "CASE (o_orderkey + o_custkey) % 4 WHEN 0 THEN '' WHEN 1 THEN 'e-' || CAST(100000 + o_orderkey AS STRING) ELSE 'E' || CAST(o_custkey AS STRING) END", "country": "CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'cuba' WHEN 2 THEN 'united  kingdom' ELSE 'Kingdom' END",
    "recordedBy": "CASE o_custkey % 3 WHEN 0 THEN 'Lahtivirta, K. I.' WHEN 1 THEN 'Mora' ELSE 'nan' END", "eventDate": "CASE o_custkey % 3 WHEN 0 THEN '3 Mar 1921' ELSE '1921' END",
}
_FLAG = "CASE (o_orderkey + {i}) % 5 WHEN 0 THEN 'True' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0' ELSE NULL END"
_STATUS = "CASE o_custkey % 11 WHEN 0 THEN 'not_evaluated' WHEN 1 THEN 'parse_failure' ELSE 'ok' END"
_SHOWN = ["catalogNumber", "recordedBy"]


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey AS record", "CASE WHEN o_orderkey % 2 = 0 THEN 'lean' ELSE 'full' END AS branch", *(f"{v} AS {k}" for k, v in _PRED.items()), *(f"{_FLAG.format(i=i)} AS {k}_review_required" for i, k in enumerate(_PRED)), f"{_STATUS} AS status")


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey AS record", *(f"{v} AS {k}" for k, v in _GOLD.items()))


_SCORED = f"""long AS ({' UNION ALL '.join(f"SELECT o_orderkey AS record, CASE WHEN o_orderkey % 2 = 0 THEN 'lean' ELSE 'full' END AS branch, '{f}' AS field, {S.clean(_PRED[f])} AS prediction, {S.clean(_GOLD[f])} AS gold, lower(trim(coalesce({_FLAG.format(i=i)}, ''))) NOT IN ({S.listed(R.FALSE_WORDS)}) AS review_required FROM orders" for i, f in enumerate(_FIELDS))}),
    normal AS (SELECT *, {S.normal_value('field', 'prediction')} AS p, {S.normal_value('field', 'gold')} AS g FROM long WHERE gold <> ''),
    exact AS (SELECT *, {S.exact('field', 'prediction', 'gold', 'p', 'g')} AS e FROM normal),
    detail AS (SELECT record, branch, field, CAST(prediction <> '' AS DOUBLE) AS coverage, CASE WHEN prediction <> '' THEN e ELSE 0 END AS exact_match, CASE WHEN prediction = '' THEN 0.0 WHEN field = 'catalogNumber' THEN CAST(e AS DOUBLE) ELSE {S.bag_f1(S.bag('p'), S.bag('g'))} END AS token_f1, review_required FROM exact)"""


@register.add(f"""WITH {_SCORED} SELECT branch, field, round(avg(coverage), 6) AS coverage, round(avg(exact_match), 6) AS exact_match, round(avg(token_f1), 6) AS token_f1, round(avg(CAST(review_required AS DOUBLE)), 6) AS review_required_rate, count(*) AS n FROM detail GROUP BY 1, 2""")
def branch_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by branch and field, with zeros for missing predictions."""
    return comparisons.branch_fields(comparisons.branch_detail(_predicted(spark, sf), _gold(spark, sf), _FIELDS))


_KINDS = ["barcode", "stamp", "number", "printed_label"]


@register.add(f"""WITH {_SCORED}, scores AS (SELECT branch, round(avg(coverage), 6) AS coverage, round(avg(exact_match), 6) AS exact_match, round(avg(token_f1), 6) AS token_f1, round(avg(CAST(review_required AS DOUBLE)), 6) AS review_required_rate,
      {', '.join(f"round(avg(CASE WHEN field = '{f}' THEN exact_match END), 6) AS {f}_exact_match" for f in _SHOWN)} FROM detail GROUP BY 1),
    ran AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'lean' ELSE 'full' END AS branch, count(DISTINCT o_orderkey) AS records, {', '.join(f"round(avg(CASE WHEN {_STATUS} = '{s}' THEN 1.0 ELSE 0.0 END), 6) AS {s}_rate" for s in ('not_evaluated', 'parse_failure'))} FROM orders GROUP BY 1),
    parts AS (SELECT l_orderkey AS record, count(*) AS n, count(*) FILTER (WHERE {S.case('l_partkey', _KINDS)} IN ('barcode', 'number')) AS ids FROM lineitem GROUP BY 1),
    whole AS (SELECT round(avg(coalesce(n, 0)), 6) AS component_count, round(avg(CASE WHEN coalesce(ids, 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS identifier_component_recall_proxy, round(avg(CASE WHEN o_custkey % 6 = 0 THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate FROM orders LEFT JOIN parts ON record = o_orderkey)
    SELECT * FROM ran JOIN scores USING (branch), whole""")
def branch_table(spark: SparkSession, sf: str) -> DataFrame:
    """The table of branches: means, failures, components and exact matches by field."""
    predicted = _predicted(spark, sf)
    detail = comparisons.branch_detail(predicted, _gold(spark, sf), _FIELDS)
    components = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.expr(S.case("l_partkey", _KINDS)).alias("kind"))
    fallen = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), F.when(F.col("o_custkey") % 6 == 0, "yes").otherwise("no").alias("fallback_used"))
    return comparisons.branch_table(detail, predicted, _gold(spark, sf), components, fallen, _SHOWN)


_REFERENCE = {"coverage": 0.304, "exact_match": 0.125, "token_f1": 0.156}


@register.add(f"""WITH {_SCORED}, o AS (SELECT count(*) FILTER (WHERE event_type <> 'error' AND user_id % 7 > 0) AS parsed_records, round(avg(CASE WHEN event_type <> 'error' AND user_id % 7 > 0 THEN 1.0 ELSE 0.0 END), 6) AS parse_success_rate, count(*) FILTER (WHERE value > 50) AS taxonomy_corrections, CAST(sum(TRY_CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS total_tokens FROM events),
    b AS (SELECT count(*) AS barcode_records, count(*) FILTER (WHERE n > 0) AS barcode_records_with_values, count(*) FILTER (WHERE n > 1) AS barcode_ambiguous_records FROM (SELECT l_orderkey, count(*) FILTER (WHERE l_partkey % 3 = 0) AS n FROM lineitem GROUP BY 1)),
    d AS (SELECT detail.*, CAST(coverage > 0 AND record % 3 = 0 AS INT) AS unsupported FROM detail)
    SELECT count(DISTINCT record) AS records, count(*) AS evaluable_field_units, {', '.join(f'round(avg({c}), 6) AS {c}' for c in _REFERENCE)}, round(avg(exact_match) FILTER (WHERE coverage > 0), 6) AS exact_match_among_filled, round(avg(token_f1) FILTER (WHERE coverage > 0), 6) AS token_f1_among_filled,
      round(avg(unsupported) FILTER (WHERE coverage > 0), 6) AS unsupported_prediction_rate, round(avg(CAST(review_required AS DOUBLE)) FILTER (WHERE coverage > 0), 6) AS review_required_rate, any_value(o.parsed_records) AS parsed_records, any_value(o.parse_success_rate) AS parse_success_rate, any_value(o.taxonomy_corrections) AS taxonomy_corrections, any_value(o.total_tokens) AS total_tokens,
      any_value(b.barcode_records) AS barcode_records, any_value(b.barcode_records_with_values) AS barcode_records_with_values, any_value(b.barcode_ambiguous_records) AS barcode_ambiguous_records, {', '.join(f'round(round(avg({c}), 6) - {v}, 6) AS {c}_delta' for c, v in _REFERENCE.items())} FROM d, o, b""")
def overall_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row over a whole run."""
    detail = comparisons.branch_detail(_predicted(spark, sf), _gold(spark, sf), _FIELDS).withColumn("evaluable", F.lit(1)).withColumn("unsupported", ((F.col("coverage") > 0) & (F.col("record") % 3 == 0)).cast("int"))
    outputs = table(spark, sf, "events").select((F.col("event_type") != "error").alias("parsed"), (F.col("user_id") % 7 == 0).alias("not_evaluated"), F.get_json_object("props", "$.k").try_cast("long").alias("tokens"), "value")
    barcodes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey").cast("string")).alias("barcode"))
    return comparisons.overall(detail, outputs, barcodes, F.col("value") > 50, _REFERENCE)


# Two methods on one record, and the rules beside them.
_METHODS = """SELECT o_orderkey AS record, 'country' AS field, 'm_no_rag' AS method, o_custkey % 10 / 10.0 AS f1, o_custkey % 3 = 0 AS failed, o_custkey % 5 = 0 AS held FROM orders
    UNION ALL SELECT o_orderkey, 'country', 'm_rag', (o_custkey + o_orderkey) % 10 / 10.0, FALSE, o_orderkey % 5 = 0 FROM orders WHERE o_orderkey % 6 > 0 UNION ALL SELECT o_orderkey, 'country', 'rule_ocr', 0.5, FALSE, FALSE FROM orders"""


def _methods(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    key, other, none = F.col("o_orderkey"), F.col("o_custkey"), F.lit(False)
    row = lambda method, f1, failed, held: F.struct(F.lit(method).alias("method"), f1.cast("double").alias("f1"), failed.alias("failed"), held.alias("held"))
    made = F.array(row("m_no_rag", other % 10 / 10.0, other % 3 == 0, other % 5 == 0), row("m_rag", (other + key) % 10 / 10.0, none, key % 5 == 0), row("rule_ocr", F.lit(0.5), none, none))
    rows = orders.select(key.alias("record"), F.lit("country").alias("field"), F.inline(made)).filter((F.col("method") != "m_rag") | (F.col("record") % 6 > 0))
    return rows.select("record", "field", "method", F.when(~F.col("held"), F.col("f1")).alias("token_f1"), F.when(~F.col("held"), (F.col("f1") > 0.8).cast("int")).alias("exact_match"), F.col("failed").alias("parse_failure"), F.col("held").alias("not_evaluated"), (~F.col("held")).cast("int").alias("evaluable"))


_DELTA = f"""m AS (SELECT record, field, method, CASE WHEN NOT held THEN f1 END AS f FROM ({_METHODS})), x AS (SELECT a.record, a.field, a.f AS token_f1_no_rag, b.f AS token_f1_rag, round(b.f - a.f, 6) AS token_f1_delta FROM m a JOIN m b ON a.record = b.record AND a.field = b.field WHERE a.method = 'm_no_rag' AND b.method = 'm_rag')"""


@register.add(f"""WITH {_DELTA} SELECT 'm_no_rag' AS control, 'm_rag' AS tested, round(avg(token_f1_delta), 6) AS mean_delta, CASE WHEN round(avg(token_f1_delta), 6) > 0 THEN 'improved mean token F1 by ' || printf('%.3f', abs(round(avg(token_f1_delta), 6))) WHEN round(avg(token_f1_delta), 6) < 0 THEN 'reduced mean token F1 by ' || printf('%.3f', abs(round(avg(token_f1_delta), 6))) ELSE 'no average difference' END AS verdict FROM x""")
def method_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """What a method gains over its control, in words."""
    return comparisons.verdict(_methods(spark, sf))


@register.add(f"""WITH {_DELTA}, s AS (SELECT *, CASE WHEN token_f1_delta > 0 THEN 'helped' ELSE 'hurt' END AS side FROM x WHERE token_f1_delta IS NOT NULL)
    SELECT record, field, token_f1_no_rag, token_f1_rag, token_f1_delta, side FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY record, field) AS k FROM s) WHERE k <= 10""")
def method_sides(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows that gained and that did not."""
    delta = comparisons.method_delta(_methods(spark, sf))
    return comparisons.helped_and_hurt(delta).select("record", "field", "token_f1_no_rag", "token_f1_rag", "token_f1_delta", "side")


@register.add(f"""WITH m AS (SELECT record, field, method, CASE WHEN NOT held THEN f1 END AS f FROM ({_METHODS})) SELECT record, field, {', '.join(f"max(CASE WHEN method = '{m}' THEN CAST(f AS VARCHAR) END) AS value_{m}, max(CASE WHEN method = '{m}' THEN f END) AS f1_{m}" for m in ('m_no_rag', 'm_rag'))} FROM m GROUP BY 1, 2""")
def field_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Values and scores of each method side by side."""
    rows = _methods(spark, sf)
    return comparisons.by_method(rows.withColumn("value", F.col("token_f1").cast("string")), ["m_no_rag", "m_rag"])


@register.add("""WITH o AS (SELECT event_id AS record, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END AS backend, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE props END AS raw, CASE event_id % 6 WHEN 0 THEN 'False' WHEN 1 THEN NULL ELSE 'true' END AS attempted,
      event_type = 'error' AS failed, event_id % 9 = 0 AS held, CASE WHEN event_id % 4 < 2 THEN 'empty_raw_output' END AS reason FROM events),
    r AS (SELECT DISTINCT user_id * 3 AS record FROM events), l AS (SELECT record, arg_max(ok, event_id) AS ok, arg_max(off, event_id) AS off FROM (SELECT user_id * 3 AS record, event_id, value > 30 AS ok, value > 90 AS off FROM events) GROUP BY 1),
    d AS (SELECT o.*, coalesce(raw, '') <> '' AS full_, coalesce(lower(attempted), 'true') <> 'false' AS tried, coalesce(l.ok, FALSE) AS reached, held OR coalesce(l.off, FALSE) AS out_ FROM o LEFT JOIN l ON l.record = o.record)
    SELECT (SELECT string_agg(b, ', ' ORDER BY b) FROM (SELECT DISTINCT backend AS b FROM d WHERE backend <> '')) AS backend, count(*) AS records, count(*) FILTER (WHERE tried) AS llm_calls_attempted, count(*) FILTER (WHERE NOT tried) AS llm_calls_skipped, count(*) FILTER (WHERE full_) AS raw_output_nonempty, count(*) FILTER (WHERE NOT full_) AS empty_raw_outputs,
      count(*) FILTER (WHERE NOT full_ AND reached AND reason = 'empty_raw_output') AS api_empty_responses, round(count(*) FILTER (WHERE NOT full_ AND reached AND reason = 'empty_raw_output') / count(*), 6) AS api_empty_response_rate, count(*) FILTER (WHERE full_ AND NOT failed AND NOT out_) AS parsed_records, count(*) FILTER (WHERE failed) AS parse_failures,
      count(*) FILTER (WHERE out_) AS not_evaluated, bool_or(reached) AS endpoint_reachable FROM d""")
def diagnostics_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with the last report on each, counted."""
    events = table(spark, sf, "events")
    key = F.col("event_id")
    raw = F.when(key % 4 == 0, "").when(key % 4 == 1, None).otherwise(F.col("props"))
    outputs = events.select(key.alias("record"), F.lit("m").alias("method"), F.expr("CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE '' END").alias("backend"), raw.alias("raw_output"), F.when(key % 6 == 0, "False").when(key % 6 == 1, None).otherwise("true").alias("attempted"), (F.col("event_type") == "error").alias("parse_failure"), (key % 9 == 0).alias("not_evaluated"), F.when(key % 4 < 2, "empty_raw_output").alias("not_evaluated_reason"))
    reports = events.select((F.col("user_id") * 3).alias("record"), F.lit("m").alias("method"), (F.col("value") > 30).alias("endpoint_reachable"), (F.col("value") > 90).alias("not_evaluated"), key.alias("place"))
    return comparisons.diagnostics(outputs, reports, "place")[1]


@register.add(f"""WITH g AS (SELECT o_orderkey AS record, o_custkey % 2 AS m, {_GOLD['country']} AS country, {_PRED['country']} AS pred, {_GOLD['recordedBy']} AS who, {_PRED['recordedBy']} AS said, CASE WHEN lower({S.clean(_PRED['country'])}) = 'kingdom' THEN 'United Kingdom' ELSE {_PRED['country']} END AS canonical FROM orders),
    l AS (SELECT m, 'country' AS field, {S.normal('canonical')} AS p, {S.normal('country')} AS g, {S.clean('canonical')} <> '' AS there FROM g WHERE {S.clean('country')} <> '' UNION ALL SELECT m, 'recordedBy', {S.normal('said')}, {S.normal('who')}, {S.clean('said')} <> '' FROM g WHERE {S.clean('who')} <> '')
    SELECT 'm' || m AS method, field, count(*) AS n_evaluable, round(avg(CAST(there AS DOUBLE)), 6) AS prediction_coverage, round(avg(CASE WHEN p = g THEN 1.0 ELSE 0.0 END), 6) AS exact_match, round(avg({S.bag_f1(S.bag('p'), S.bag('g'))}), 6) AS token_f1 FROM l GROUP BY 1, 2""")
def canonical_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by method and field, with canonical values where there are some."""
    orders = table(spark, sf, "orders")
    predicted = orders.selectExpr("o_orderkey AS record", "'m' || CAST(o_custkey % 2 AS STRING) AS method", f"{_PRED['country']} AS country", f"{_PRED['recordedBy']} AS recordedBy")
    predicted = predicted.withColumn("country_canonical", F.when(F.lower(T.clean(F.col("country"))) == "kingdom", "United Kingdom").otherwise(F.col("country")))
    return comparisons.canonical_scores(predicted, _gold(spark, sf), ["country", "recordedBy"], {"country": "country_canonical", "recordedBy": "missing"})


_TYPES = ["barcode", "printed_label", "number", "stamp", "type_label"]


@register.add(f"""WITH c AS (SELECT l_orderkey AS record, 'crop' || l_partkey % 9 || '.jpg' AS path, max(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_discount END) AS sure FROM lineitem WHERE {S.case('l_partkey', _TYPES)} IN ({S.listed(comparisons.TEXT_TYPES)}) AND l_partkey % 9 > 0 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY sure DESC, path) AS k FROM c) SELECT record, string_agg(path, ';' ORDER BY k) AS paths FROM r WHERE k <= 2 GROUP BY 1""")
def text_crops(spark: SparkSession, sf: str) -> DataFrame:
    """The files of text-bearing components, the surest first."""
    path = F.when(F.col("l_partkey") % 9 > 0, F.concat(F.lit("crop"), (F.col("l_partkey") % 9).cast("string"), F.lit(".jpg"))).otherwise("nan")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.expr(S.case("l_partkey", _TYPES)).alias("kind"), path.alias("path"), F.when(F.col("l_suppkey") % 5 == 0, "high").otherwise(F.col("l_discount").cast("string")).alias("confidence"))
    return comparisons.text_paths(rows, 2).select("record", F.array_join("paths", ";").alias("paths"))


_READ = ["K. Lahtivirta", "lahtivirta", "Lahtivirta K", "unreadable", "", None, "Mora y Diaz", "xq"]
_SOURCE = ["", "Lahtivirta, K. I. 1921", "Lahti", "Kew", "x", "y", "A. Mora y Díaz leg.", "Mora"]


@register.add(f"""WITH RECURSIVE i AS (SELECT o_orderkey, {S.case('o_orderkey', _READ)} AS text, {S.case('o_orderkey // 8', _SOURCE)} AS source FROM orders), n AS (SELECT *, {S.clean('text')} AS value, {S.alnum('text')} AS a, {S.alnum('source')} AS b FROM i),
    pairs AS (SELECT DISTINCT a, b FROM n WHERE a <> '' AND b <> ''), {S.matching_ratio('pairs', 'pairs.a', 'pairs.b')}
    SELECT o_orderkey, CASE WHEN value = '' THEN 'empty_output' WHEN regexp_matches(value, '(^|\\s)[A-Z]\\.') THEN 'collector_initial' WHEN coalesce(ratio, 0) >= 0.55 THEN 'collector_ocr_agreement' ELSE 'collector_unconfirmed' END AS verdict, round(coalesce(ratio, 0), 6) AS agreement FROM n LEFT JOIN ratio ON ratio.a = n.a AND ratio.b = n.b""")
def collector_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the reading of a collector's region is plausible."""
    text, source = F.expr(S.case("o_orderkey", _READ)), F.expr(S.case("o_orderkey div 8", _SOURCE))
    rows = table(spark, sf, "orders").select("o_orderkey", text.alias("text"), source.alias("source"))
    judged = rows.withColumn("r", similarity.collector_reading(F.col("text"), F.col("source")))
    return judged.select("o_orderkey", "r.verdict", F.round("r.agreement", 6).alias("agreement"))


_K = "CAST(o_orderkey AS STRING)"
_ANSWERS = f"""CASE o_orderkey % 9 WHEN 0 THEN '```json ' || '{{"record": {{"catalog_number": {{"text": "E' || {_K} || '", "confidence": 0.8}}}}}} ```' WHEN 1 THEN '[{{"catalogNumber": "E' || {_K} || '"}}]' WHEN 2 THEN 'said: {{"barcode": {{"value": "' || {_K} || '", "confidence": 2}}}} end' WHEN 3 THEN '{{"note": "x"}}'
    WHEN 4 THEN '{{"data": {{"Barcode": 5, "country": {{"answer": "Cuba"}}}}}}' WHEN 5 THEN 'not json' WHEN 6 THEN '{{"catalogNumber": {{"value": "a", "confidence": "high", "evidence_span": "b"}}, "country": null}}' WHEN 7 THEN '{{"latitude": "95.5", "country": {{"value": "UK", "confidence": -1}}}}' ELSE NULL END"""
_NAMED = {"catalogNumber": ["catalogNumber", "catalog_number", "barcode", "Barcode"], "country": ["country"], "decimalLatitude": ["decimalLatitude", "latitude"]}


def _picked(f: str) -> str:
    other = lambda suffix: "coalesce(" + ", ".join(f"{f}_i ->> '$.{k}'" for k in ("text", "answer")) + f", {suffix})"
    own = f"json_type({f}_i, '$.value') IS NOT NULL OR coalesce({f}_i ->> '$.text', {f}_i ->> '$.answer') IS NULL"
    sure = f"({f}_i ->> '$.confidence')"
    return f"""CASE WHEN {f}_i IS NULL THEN '' WHEN json_type({f}_i) = 'OBJECT' THEN CASE WHEN {own} THEN coalesce({f}_i ->> '$.value', '') ELSE {other("''")} END ELSE coalesce({f}_i ->> '$', '') END AS {f},
      CASE WHEN {f}_i IS NULL THEN 0.0 WHEN json_type({f}_i) = 'OBJECT' THEN CASE WHEN {sure} IS NULL THEN CASE WHEN {own} THEN 0.0 ELSE 0.5 END ELSE TRY_CAST({sure} AS DOUBLE) END ELSE 0.5 END AS {f}_c,
      CASE WHEN {f}_i IS NULL THEN '' WHEN json_type({f}_i) = 'OBJECT' THEN CASE WHEN {own} OR json_type({f}_i, '$.evidence_span') IS NOT NULL THEN coalesce({f}_i ->> '$.evidence_span', '') ELSE {other("''")} END ELSE coalesce({f}_i ->> '$', '') END AS {f}_e"""


@register.add(f"""WITH a AS (SELECT o_orderkey, regexp_replace(regexp_replace({S.clean(_ANSWERS)}, '^```[a-z]*\\s*', '', 'i'), '\\s*```$', '') AS bare FROM orders), b AS (SELECT o_orderkey, CASE WHEN json_valid(bare) THEN bare WHEN json_valid(regexp_extract(bare, '\\{{.*\\}}', 0, 's')) THEN regexp_extract(bare, '\\{{.*\\}}', 0, 's') END AS body FROM a),
    o AS (SELECT o_orderkey, CASE WHEN json_type(body) = 'ARRAY' THEN CASE WHEN json_array_length(body) = 1 THEN json_extract(body, '$[0]') END WHEN json_type(body) = 'OBJECT' THEN CAST(body AS JSON) END AS obj FROM b),
    n AS (SELECT o_orderkey, CASE WHEN json_type(obj, '$.record') = 'OBJECT' THEN json_extract(obj, '$.record') WHEN json_type(obj, '$.data') = 'OBJECT' THEN json_extract(obj, '$.data') ELSE obj END AS inside FROM o),
    i AS (SELECT o_orderkey, {', '.join(f"coalesce({', '.join(f'json_extract(inside, {chr(39)}$.{k}{chr(39)})' for k in ks)}) AS {f}_i" for f, ks in _NAMED.items())} FROM n),
    p AS (SELECT *, {', '.join(_picked(f) for f in _NAMED)} FROM i)
    SELECT o_orderkey, {' OR '.join(f'{f}_i IS NOT NULL' for f in _NAMED)} AS parsed, {', '.join(f'{f} AS "{f}", greatest(0.0, least(1.0, coalesce({f}_c, 0.0))) AS "{f}_confidence", {f}_e AS "{f}_evidence_span"' for f in _NAMED)},
      concat_ws(';', {', '.join(f"CASE WHEN {f}_i IS NOT NULL AND json_type({f}_i) <> 'OBJECT' THEN 'coerced_field:{f}' END, CASE WHEN {f}_c IS NULL THEN 'bad_confidence:{f}' END, CASE WHEN {f}_c NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range:{f}' END" for f in _NAMED)}, CASE WHEN "decimalLatitude" = '95.5' THEN 'decimalLatitude_out_of_range' END) AS validation_warnings FROM p""")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Models' answers as typed records, flat."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_ANSWERS} AS raw").withColumn("record", answers.llm_record(F.col("raw"), list(_NAMED)))
    return rows.select("o_orderkey", F.col("record").isNotNull().alias("parsed"), *answers.flat(F.col("record"), list(_NAMED)))


_VISION = f"""CASE o_orderkey % 4 WHEN 0 THEN '{{"transcriptions": [{{"image_index": 3, "text": " a' || {_K} || ' ", "uncertain_spans": "u"}}, "b", 5, {{"text": "c"}}], "observations": ["x", " ", null, "y"]}}' WHEN 1 THEN '{{"transcriptions": {{"text": "t' || {_K} || '"}}, "observations": "one"}}' WHEN 2 THEN '[1]' ELSE 'so {{"transcriptions": "no list", "fields": 3}}' END"""


@register.add(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' || {_K} || chr(10) || chr(10) || 'b' || chr(10) || chr(10) || 'c' WHEN 1 THEN 't' || {_K} WHEN 3 THEN '' END AS full_transcription, CASE o_orderkey % 4 WHEN 0 THEN '3:u|2:|4:' WHEN 1 THEN '1:' WHEN 3 THEN '' END AS parts, CASE o_orderkey % 4 WHEN 0 THEN 'x,y' WHEN 1 THEN 'one' WHEN 3 THEN '' END AS observations FROM orders""")
def vision_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Vision models' answers: transcriptions, doubts and observations."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_VISION} AS raw").withColumn("v", answers.vision_answer(F.col("raw"), ["country"]))
    parts = F.array_join(F.transform("v.transcriptions", lambda t: F.concat(t["image_index"], F.lit(":"), F.array_join(t["uncertain_spans"], ","))), "|")
    return rows.select("o_orderkey", "v.full_transcription", parts.alias("parts"), F.array_join("v.observations", ",").alias("observations"))


@register.add("""SELECT c_custkey, sha256('[{"content":"Return JSON.","role":"system"},{"content":"' || c_name || '","role":"user"}]') AS prompt_sha256, CAST(CAST('0x' || substr(sha256(c_mktsegment), 1, 8) AS BIGINT) % 10000 AS INT) AS stratum_offset FROM customer""")
def prompt_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of prompts, and offsets of strata."""
    return table(spark, sf, "customer").select("c_custkey", comparisons.prompt_digest(F.lit("Return JSON."), F.col("c_name")).alias("prompt_sha256"), comparisons.stratum_offset(F.col("c_mktsegment")).alias("stratum_offset"))
