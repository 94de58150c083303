"""Registered queries on the rules by field, and their oracle SQL.

Inputs are dealt by key from written values, the same for both engines; results are computed from them by either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import fields as R
from .functions import text as T
from .registry import Register
from .sources.files import table

register = Register()

_PAIRS = [
    ("catalogNumber", "B 10 0355192", "B100355192"), ("catalogNumber", "TU 351001", "TU351001"), ("catalogNumber", "E00633258", "E00633257"), ("eventDate", "19 Aug 1960", "1960-08-19"),
    ("eventDate", "1953-12-05/1953-12-07", "1953-12-05"), ("eventDate", "3rd March, 1921.", "03/03/1921"), ("eventDate", "1921-03", "1921"), ("recordedBy", "K. I. Lahtivirta", "Lahtivirta, K. I."),
    ("recordedBy", "Mora", "A. Mora y Díaz"), ("typeStatus", "Isotype of Carex lutensis", "isotype"), ("typeStatus", "no status", "HOLOTYPE!"), ("decimalLatitude", "51.50004", "51.5"),
    ("decimalLatitude", "51.6", "51.5"), ("decimalLongitude", "west", "West "), ("country", "  United   Kingdom", "united kingdom!"), ("country", "none", ""), ("scientificName", "Rosa canina L.", "rosa canina"), ("eventDate", "12345/67890", "nan"),
]


def _dealt(key: str, rows: list[tuple], names: list[str]) -> str:
    return ", ".join(f"{S.case(key, [r[i] for r in rows])} AS {name}" for i, name in enumerate(names))


_IN = f"SELECT o_orderkey, {_dealt('o_orderkey', _PAIRS, ['field', 'pred', 'gold'])} FROM orders"


def _rows(spark: SparkSession, sf: str, name: str, key: str, rows: list[tuple], names: list[str]) -> DataFrame:
    return table(spark, sf, name).selectExpr(key, *(f"{S.case(key, [r[i] for r in rows])} AS {n}" for i, n in enumerate(names)))


@register.add(f"""WITH i AS ({_IN}), n AS (SELECT *, {S.normal_value('field', 'pred')} AS normal_pred, {S.normal_value('field', 'gold')} AS normal_gold FROM i),
    e AS (SELECT *, {S.exact('field', 'pred', 'gold', 'normal_pred', 'normal_gold')} AS exact FROM n)
    SELECT o_orderkey, field, normal_pred, normal_gold, exact,
      round(CASE WHEN field IN ('catalogNumber', 'typeStatus', 'decimalLatitude', 'decimalLongitude') THEN CAST(exact AS DOUBLE) ELSE {S.bag_f1(S.bag('normal_pred'), S.bag('normal_gold'))} END, 6) AS f1 FROM e""")
def field_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Normal forms, exact match and token F1 by field."""
    rows = _rows(spark, sf, "orders", "o_orderkey", _PAIRS, ["field", "pred", "gold"])
    field, pred, gold, p, g = map(F.col, ("field", "pred", "gold", "normal_pred", "normal_gold"))
    rows = rows.withColumns({"normal_pred": R.normal_value(field, pred), "normal_gold": R.normal_value(field, gold)})
    rows = rows.withColumn("exact", R.exact_of(field, pred, gold, p, g))
    return rows.select("o_orderkey", "field", "normal_pred", "normal_gold", "exact", F.round(R.f1_of(field, F.col("exact"), p, g), 6).alias("f1"))


_FLAGS = ["False", "0", "True", "yes", " NO ", None, "nan", "maybe", "f", "1", ""]


@register.add(f"""WITH i AS (SELECT event_id, {S.case('event_id', _FLAGS)} AS flag FROM events), n AS (SELECT *, lower(trim(coalesce(flag, ''))) AS low FROM i)
    SELECT event_id, low NOT IN ({S.listed(R.FALSE_WORDS)}) AS loose, low IN ('true', '1') AS strict, low IN ('1', 'true', 'yes') AS wide FROM n""")
def textual_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Three readings of textual flags (F2, F16)."""
    flag = F.expr(S.case("event_id", _FLAGS))
    return table(spark, sf, "events").select("event_id", R.truthy(flag).alias("loose"), R.truthy(flag, ["true", "1"]).alias("strict"), R.truthy(flag, ["1", "true", "yes"]).alias("wide"))


_LABELS = ["full database label", "Database:Number", "specimen_label", "barcode", " printed  label", "type", "stamp", None, "ruler", "handwritten_data"]


@register.add(f"""WITH i AS (SELECT l_orderkey, l_linenumber, {S.case('l_partkey', _LABELS)} AS label, l_discount AS sure, CASE WHEN l_partkey % 3 = 0 THEN 'E' || l_partkey ELSE '' END AS text, CASE WHEN l_suppkey % 4 = 0 THEN 'E00' || l_partkey ELSE NULL END AS code,
      CASE l_suppkey % 3 WHEN 0 THEN 'hespi' WHEN 1 THEN 'yoloe26' ELSE 'other' END AS detector, l_quantity * 97 AS sharp, l_tax * 10 AS area FROM lineitem),
    k AS (SELECT *, {S.component_type('label')} AS kind FROM i), r AS (SELECT *, {S.role('kind')} AS role, CASE WHEN {S.clean('code')} <> '' THEN code ELSE text END AS best FROM k)
    SELECT l_orderkey, l_linenumber, kind, role, CASE WHEN role = 'other' THEN 'unsupported_component_type' WHEN sure < {S.looked_up(R.THRESHOLDS, 'kind', '0.10')} THEN 'below_class_threshold'
        WHEN {S.clean('text')} <> '' OR {S.clean('code')} <> '' THEN 'direct_text_evidence' WHEN role IN ('primary_label', 'annotation') AND sure >= 0.20 THEN 'vision_only_high_confidence' ELSE 'empty_evidence' END AS gate,
      round(sure * 100 + least(length(text), 160) / 8.0 + least(sharp / 250.0, 12.0) + CASE WHEN text <> '' THEN 18 ELSE 0 END + CASE WHEN code IS NOT NULL THEN 70 ELSE 0 END + CASE WHEN {S.plausible('best')} THEN 35 ELSE 0 END
        + {S.looked_up(R.ROLE_BONUS, 'role', '0.0')} + CASE WHEN detector = 'hespi' AND role IN ('primary_label', 'annotation') THEN 12 ELSE 0 END + CASE WHEN detector = 'yoloe26' AND role LIKE 'identifier%' THEN 8 ELSE 0 END
        - CASE WHEN area > 0.6 THEN 35 WHEN area > 0.4 AND role <> 'primary_label' THEN 20 ELSE 0 END, 4) AS utility FROM r""")
def region_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Component types and roles, the evidence gate and the utility of regions."""
    rows = table(spark, sf, "lineitem").selectExpr("*", f"{S.case('l_partkey', _LABELS)} AS label", "CASE WHEN l_partkey % 3 = 0 THEN 'E' || l_partkey ELSE '' END AS text", "CASE WHEN l_suppkey % 4 = 0 THEN 'E00' || l_partkey ELSE NULL END AS code", "CASE l_suppkey % 3 WHEN 0 THEN 'hespi' WHEN 1 THEN 'yoloe26' ELSE 'other' END AS detector")
    label, text, code = F.col("label"), F.col("text"), F.col("code")
    worth = R.utility(label, F.col("detector"), F.col("l_discount"), text, code, F.col("l_quantity") * 97, F.col("l_tax") * 10)
    return rows.select("l_orderkey", "l_linenumber", R.component_type(label).alias("kind"), R.component_role(label).alias("role"), R.evidence_gate(label, F.col("l_discount"), text, code).alias("gate"), F.round(worth, 4).alias("utility"))


_IDS = ["E00633257", "BM 000625315", "591", "ABCDEFG", "K-12", "a b c 12345", "MEL 123456789012345", "E 12345", None, "P00123456 x", "12345678"]
_OWN = "^(?:E|BM)"


@register.add(f"""WITH i AS (SELECT c_custkey, {S.case('c_custkey', _IDS)} AS value FROM customer), k AS (SELECT *, {S.identifier('value')} AS key FROM i)
    SELECT c_custkey, {S.plausible('value')} AS plausible, CAST(CASE WHEN NOT {S.plausible('value')} THEN -100.0 ELSE
      CASE WHEN regexp_full_match(key, '[A-Z]{{1,4}}\\d{{5,12}}') THEN 35.0 WHEN regexp_full_match(key, '[A-Z0-9]{{6,16}}') THEN 10.0 ELSE -20.0 END
      + CASE WHEN regexp_full_match(key, '(?:E|BM)\\d{{5,12}}') THEN 80.0 WHEN regexp_matches(key, '{_OWN}') THEN 25.0 ELSE -25.0 END
      + CASE WHEN len(string_split_regex({S.clean('value')}, '\\s+')) > 2 THEN -30.0 ELSE 0.0 END END AS DOUBLE) AS score,
      CASE WHEN regexp_matches(key, '[A-Z]') AND regexp_matches(key, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN length(key) BETWEEN 7 AND 16 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(key, '^[A-Z]') THEN 1 ELSE 0 END - CASE WHEN regexp_full_match(key, '[0-9]+') THEN 2 ELSE 0 END AS pattern FROM k""")
def identifier_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Plausible identifiers and their shape scores (F10, X11, the pattern score of A5)."""
    value = F.expr(S.case("c_custkey", _IDS))
    return table(spark, sf, "customer").select("c_custkey", R.plausible_identifier(value).alias("plausible"), R.shape_score(value, ["E", "BM"]).alias("score"), R.pattern_score(T.identifier_key(value)).alias("pattern"))


_READ = ["12", "May 5", "Sept", "1921", "year 1850 or so", "32", None, "none", "13", "no", "1921 1922", "7 8"]
_REGION = ["day", "month", "month", "year", "year", "day", "day", "year", "month", "collector", "year", "day"]
_SOURCE = ["", "", "", "in 1921 seen", "1851", "", "", "", "", "", "", ""]
_MONTH_WORDS = [*R.MONTHS, *R.MONTH_NAMES, *map(str, range(1, 13)), *(f"{m:02d}" for m in range(1, 10))]


@register.add(f"""WITH i AS (SELECT o_orderkey, {S.case('o_orderkey', _READ)} AS text, {S.case('o_orderkey', _REGION)} AS region, {S.case('o_orderkey', _SOURCE)} AS source FROM orders),
    t AS (SELECT *, regexp_extract_all({S.clean('text')}, '[A-Za-z]+|\\d+') AS tokens FROM i),
    y AS (SELECT *, list_filter(tokens, lambda x: regexp_full_match(x, '[0-9]{{4}}')) AS years, list_filter(tokens, lambda x: regexp_full_match(x, '[0-9]+')) AS numbers, list_filter(regexp_extract_all(source, '\\d{{4}}'), lambda x: CAST(x AS INT) BETWEEN 1500 AND 2100) AS others FROM t)
    SELECT o_orderkey, CASE WHEN {S.clean('text')} = '' THEN 'empty_output'
      WHEN region = 'day' THEN CASE WHEN len(numbers) = 1 AND CAST(numbers[1] AS BIGINT) BETWEEN 1 AND 31 THEN 'plausible_day' ELSE 'implausible_day' END
      WHEN region = 'month' THEN CASE WHEN len(tokens) = 1 AND lower(tokens[1]) IN ({S.listed(_MONTH_WORDS)}) THEN 'plausible_month' ELSE 'implausible_month' END
      WHEN region = 'year' THEN CASE WHEN len(years) <> 1 OR CAST(years[1] AS INT) NOT BETWEEN 1500 AND 2100 THEN 'implausible_year' WHEN len(others) > 0 AND NOT list_contains(others, years[1]) THEN 'year_conflicts_with_tesseract' ELSE 'plausible_year' END
      ELSE 'unsupported_region_type' END AS verdict FROM y""")
def region_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a region's reading is plausible for its kind (F9, without the collector's)."""
    rows = table(spark, sf, "orders")
    at = lambda v: F.expr(S.case("o_orderkey", v))
    return rows.select("o_orderkey", R.region_reading(at(_REGION), at(_READ), at(_SOURCE)).alias("verdict"))


_PATHS, _ELIGIBLE, _PROMPTS = ["a.jpg", "", "b.jpg", None, "c.jpg"], ["true", "false", "1", None, "No", "yes"], ["text of it", "", " -- ", "ab", None, "none", "three words here"]


@register.add(f"""WITH i AS (SELECT event_id, {S.case('event_id', _PATHS)} AS path, {S.case('event_id', _ELIGIBLE)} AS ok, {S.case('event_id', _PROMPTS)} AS prompt FROM events),
    g AS (SELECT event_id, CASE WHEN {S.clean('path')} = '' THEN 'image_unavailable' WHEN lower(coalesce(ok, 'true')) IN ('false', '0', 'no') THEN 'image_not_paired_eligible' WHEN {S.clean('prompt')} = '' THEN 'empty_ocr_evidence'
      WHEN length(regexp_replace({S.clean('prompt')}, '[^A-Za-z0-9]+', '', 'g')) < 3 THEN 'insufficient_ocr_evidence' ELSE '' END AS reason FROM i)
    SELECT CASE WHEN reason = '' THEN 'none' ELSE reason END AS reason, count(*) AS n FROM g GROUP BY 1""")
def gate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why records aren't sent to a model, counted."""
    at = lambda v: F.expr(S.case("event_id", v))
    reason = R.gate_reason(at(_PATHS), at(_ELIGIBLE), at(_PROMPTS), 3)
    return table(spark, sf, "events").groupBy(F.when(reason == "", "none").otherwise(reason).alias("reason")).agg(F.count("*").alias("n"))


def _year_month_day(k: int) -> str:
    return f"coalesce(regexp_extract(value, '^(\\d{{4}})(?:-(\\d{{2}})(?:-(\\d{{2}}))?)?$', {k}), '')"




@register.add(f"""WITH i AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value,
      CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d %b %Y') WHEN 1 THEN 'noted ' || strftime(o_orderdate, '%b. %d, %Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN '' ELSE 'on ' || strftime(o_orderdate, '%b %Y') || ' x' END AS evidence FROM orders),
    p AS (SELECT *, {_year_month_day(1)} AS y, {_year_month_day(2)} AS m, {_year_month_day(3)} AS d, {S.alnum('evidence')} AS key, {S.alnum('value')} AS own FROM i),
    n AS (SELECT *, coalesce([{S.listed(R.MONTHS)}][TRY_CAST(m AS INT)], '') AS name, regexp_extract_all(lower(evidence), '[a-z]+|[0-9]+') AS w FROM p)
    SELECT o_orderkey, key <> '' AND (contains(key, own) OR CASE WHEN d <> '' THEN contains(key, d || m || y) OR contains(key, d || name || y) OR contains(key, name || d || y) ELSE contains(key, name || y) END) AS hit,
      CASE WHEN d <> '' THEN list_contains(w, y) END AS year_hit, CASE WHEN d <> '' THEN list_contains(w, m) OR list_contains(w, CAST(CAST(m AS INT) AS VARCHAR)) OR list_contains(w, name) END AS month_hit,
      CASE WHEN d <> '' THEN list_contains(w, d) OR list_contains(w, CAST(CAST(d AS INT) AS VARCHAR)) END AS day_hit FROM n""")
def date_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Dates found in evidence in any usual form, whole and by part."""
    form = lambda f: F.date_format("o_orderdate", f)
    key = F.col("o_orderkey")
    value = F.when(key % 4 == 0, form("yyyy-MM")).otherwise(form("yyyy-MM-dd"))
    evidence = F.when(key % 5 == 0, form("dd MMM yyyy")).when(key % 5 == 1, F.concat(F.lit("noted "), form("MMM. dd, yyyy"))).when(key % 5 == 2, form("dd/MM/yyyy")).when(key % 5 == 3, "").otherwise(F.concat(F.lit("on "), form("MMM yyyy"), F.lit(" x")))
    rows = table(spark, sf, "orders").select("o_orderkey", value.alias("value"), evidence.alias("evidence"))
    part = lambda p: R.date_part_hit(p, F.col("evidence"), F.col("value")).alias(f"{p}_hit")
    return rows.select("o_orderkey", R.evidence_hit(F.lit("eventDate"), F.col("value"), F.col("evidence")).alias("hit"), part("year"), part("month"), part("day"))


_TEXTS = ["Rosa canina L.", "rosa canina", "Carex", "Abies alba", " Picea  abies ", None, "Poa annua(L.)"]


@register.add(f"""WITH i AS (SELECT p_partkey, {S.case('p_partkey', _TEXTS)} AS name, p_size FROM part)
    SELECT p_partkey, regexp_matches({S.clean('name')}, '^[A-Z][a-zA-Z\\-]+\\s+[a-z][a-zA-Z\\-]+(?:\\s|$)') AS binomial, {S.clean('name')} AS value, greatest(0.0, least(1.0, (p_size - 10) / 20.0)) AS confidence,
      CASE WHEN p_size % 2 = 0 THEN 'span' ELSE {S.clean('name')} END AS span,
      concat_ws(';', CASE WHEN (p_size - 10) / 20.0 NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range:eventDate' END, CASE WHEN p_size % 5 = 0 THEN 'bad_confidence:country' END,
        CASE WHEN p_partkey % 7 = 0 THEN 'decimalLatitude_not_numeric' END, CASE WHEN p_partkey % 7 > 0 AND p_partkey % 200 > 90 THEN 'decimalLatitude_out_of_range' END, CASE WHEN p_partkey % 400 > 180 THEN 'decimalLongitude_out_of_range' END) AS warnings FROM i""")
def record_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Field structs with clamped confidences and their warnings."""
    name, size, key = F.expr(S.case("p_partkey", _TEXTS)), F.col("p_size"), F.col("p_partkey")
    sure = (size - 10) / 20.0
    made = R.make_field(name, sure, F.when(size % 2 == 0, "span"))
    bad = F.when(size % 5 == 0, "high")
    lat = F.when(key % 7 == 0, "north").otherwise((key % 200).cast("string"))
    warned = R.record_warnings({"eventDate": sure, "country": bad}, lat, (key % 400).cast("string"))
    return table(spark, sf, "part").select("p_partkey", R.looks_like_binomial(name).alias("binomial"), made.alias("f"), warned.alias("warnings")).select("p_partkey", "binomial", "f.value", "f.confidence", F.col("f.evidence_span").alias("span"), "warnings")


@register.add("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 150 - 20 AS x0, l_suppkey % 120 - 10 AS y0, l_partkey % 150 - 20 + l_quantity::INT AS x1, l_suppkey % 120 - 10 + l_linenumber AS y1 FROM lineitem),
    c AS (SELECT *, greatest(0, least(x0, 99)) AS a, greatest(0, least(y0, 79)) AS b FROM b)
    SELECT l_orderkey, l_linenumber, round(a / 100, 6) AS x0_share, round(b / 80, 6) AS y0_share, round(greatest(a + 1, least(x1, 100)) / 100, 6) AS x1_share, round(greatest(b + 1, least(y1, 80)) / 80, 6) AS y1_share FROM c""")
def boxes_clamped(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes within a sheet, as fractions of its sides."""
    x0, y0 = (F.col("l_partkey") % 150 - 20).cast("int"), (F.col("l_suppkey") % 120 - 10).cast("int")
    box = R.clamped_box(x0, y0, x0 + F.col("l_quantity").cast("int"), y0 + F.col("l_linenumber"), 100, 80)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b"))
    return rows.select("l_orderkey", "l_linenumber", *(F.col("b")[i].alias(n) for i, n in enumerate(["x0_share", "y0_share", "x1_share", "y1_share"])))


_SPOTS = ["lat 48.86 lon 2.35", "at 12.5, -70.25 m", "latitude: -3.25 longitude = 100.5", "n 95.5 45.25 160.75 x", "no place", "lat 10.5 only 20.25", "E00633257 Rosa canina France 1902 holotype"]


@register.add(f"""WITH i AS (SELECT c_custkey, {S.case('c_custkey', _SPOTS)} AS text FROM customer),
    f AS (SELECT *, coalesce(nullif(regexp_extract(text, 'lat(?:itude)?\\s*[:=]?\\s*(-?\\d{{1,2}}\\.\\d+)', 1, 'i'), ''), regexp_extract(text, '\\b(-?\\d{{1,2}}\\.\\d+)\\s*,\\s*-?\\d{{1,3}}\\.\\d+', 1)) AS lat,
      coalesce(nullif(regexp_extract(text, 'lon(?:gitude)?\\s*[:=]?\\s*(-?\\d{{1,3}}\\.\\d+)', 1, 'i'), ''), regexp_extract(text, '\\b-?\\d{{1,2}}\\.\\d+\\s*,\\s*(-?\\d{{1,3}}\\.\\d+)', 1)) AS lon,
      list_transform(regexp_extract_all(text, '-?\\d{{1,3}}\\.\\d+'), lambda x: CAST(x AS DOUBLE)) AS n FROM i),
    p AS (SELECT *, list_filter(range(1, len(n)), lambda k: n[k] BETWEEN -90 AND 90 AND n[k + 1] BETWEEN -180 AND 180)[1] AS k FROM f)
    SELECT c_custkey, CASE WHEN (lat = '' OR lon = '') AND k IS NOT NULL THEN CAST(n[k] AS VARCHAR) ELSE lat END AS latitude, CASE WHEN (lat = '' OR lon = '') AND k IS NOT NULL THEN CAST(n[k + 1] AS VARCHAR) ELSE lon END AS longitude,
      CASE WHEN regexp_matches(text, '\\bCuba\\b', 'i') THEN 'Cuba' WHEN regexp_matches(text, '\\bFrance\\b', 'i') THEN 'France' ELSE '' END AS country, lower(regexp_extract(text, '\\b(holotype|isotype|lectotype|syntype|paratype)\\b', 1, 'i')) AS type_status,
      regexp_extract(text, '\\b([A-Z][a-z]+\\s+[a-z][a-z\\-]+)\\b', 1) AS name FROM p""")
def rule_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates, country, type status and name by rules."""
    text = F.expr(S.case("c_custkey", _SPOTS))
    place = R.coordinates(text)
    return table(spark, sf, "customer").select(
        "c_custkey", place["latitude"].alias("latitude"), place["longitude"].alias("longitude"), R.canonical_country(text, ["Cuba", "France"]).alias("country"),
        F.lower(F.regexp_extract(text, r"(?i)\b(holotype|isotype|lectotype|syntype|paratype)\b", 1)).alias("type_status"), F.regexp_extract(text, r"\b([A-Z][a-z]+\s+[a-z][a-z\-]+)\b", 1).alias("name"),
    )


_TILES = "(SELECT p_partkey, p_size * 97 AS side FROM part)"


@register.add(f"""SELECT p_partkey, unnest(CASE WHEN side <= 1024 THEN [0] ELSE list_distinct(list_concat(range(0, side - 1024 + 1, 819), [side - 1024])) END)::BIGINT AS start FROM {_TILES}""")
def tile_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Starts of overlapping tiles along a side, the last flush with the edge."""
    return table(spark, sf, "part").select("p_partkey", F.explode(R.tile_starts(F.col("p_size") * 97, 1024, 0.2)).alias("start"))


_LINES = ["BM000625315\nx\n BM000625315 ", "E 0063 3257.\r\nE-00633257", "591", None, "no digits here\n12345;", "K000123456 |\nK000123456789012345678901234567890"]


@register.add(f"""WITH i AS (SELECT o_orderkey, {S.case('o_orderkey', ['{' + str(k) + '}' for k in range(len(_LINES))])} AS slot FROM orders),
    t AS (SELECT o_orderkey, CASE slot WHEN '{{0}}' THEN 'BM000625315' || chr(10) || 'x' || chr(10) || ' BM000625315 ' WHEN '{{1}}' THEN 'E 0063 3257.' || chr(13) || chr(10) || 'E-00633257' WHEN '{{2}}' THEN '591' WHEN '{{4}}' THEN 'no digits here' || chr(10) || '12345;'
      WHEN '{{5}}' THEN 'K000123456 |' || chr(10) || 'K000123456789012345678901234567890' END AS text FROM i),
    l AS (SELECT o_orderkey, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) AS k FROM t),
    s AS (SELECT o_orderkey, k, regexp_replace(regexp_replace({S.clean('line')}, '\\s+', ' ', 'g'), '^[ .,:;|_\\-]+|[ .,:;|_\\-]+$', '', 'g') AS v FROM l),
    f AS (SELECT o_orderkey, v, min(k) AS k FROM s WHERE length({S.identifier('v')}) BETWEEN 5 AND 24 AND regexp_matches(v, '[0-9]') GROUP BY 1, 2)
    SELECT o_orderkey, string_agg(v, ';' ORDER BY k) AS candidates, count(*) AS n FROM f GROUP BY 1""")
def identifier_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of readings that may be identifiers."""
    text = F.get(F.array(*(F.lit(x) for x in _LINES)), (F.col("o_orderkey") % len(_LINES)).cast("int"))
    rows = table(spark, sf, "orders").select("o_orderkey", R.identifier_lines(text).alias("found")).filter(F.size("found") > 0)
    return rows.select("o_orderkey", F.array_join("found", ";").alias("candidates"), F.size("found").cast("long").alias("n"))


