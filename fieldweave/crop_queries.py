"""Registered queries on likeness of texts, masks and the choice of regions, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import fields as R
from .functions import similarity
from .functions import text as T
from .operators import crops, geometry
from .registry import Register
from .sources.files import dealt, table

register = Register()

_FIRST_WORDS = r"regexp_extract(text, '^\s*(\S+(?:\s+\S+){0,2})', 1)"


@register.add(f"""WITH RECURSIVE words AS (SELECT DISTINCT doc_id, {S.alnum(_FIRST_WORDS)} AS k FROM documents WHERE doc_id IS NOT NULL),
    pairs AS (SELECT p.doc_id, p.k AS a, q.k AS b FROM words p JOIN words q ON q.doc_id = p.doc_id + 4 AND p.k <> '' AND q.k <> ''),
    {S.matching_ratio('pairs', 'pairs.a', 'pairs.b')}
    SELECT doc_id, round(ratio, 6) AS similarity FROM pairs JOIN ratio USING (a, b)""")
def similarity_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Matching blocks of the first words of documents and of those four further on."""
    docs = table(spark, sf, "documents").filter("doc_id is not null").select("doc_id", F.regexp_extract("text", r"^\s*(\S+(?:\s+\S+){0,2})", 1).alias("words"))
    other = docs.select((F.col("doc_id") - 4).alias("doc_id"), F.col("words").alias("words_2"))
    key = lambda c: T.alnum_key(T.clean(F.col(c)))
    pairs = docs.join(other, "doc_id").filter((key("words") != "") & (key("words_2") != ""))
    return pairs.select("doc_id", F.round(similarity.text_similarity(F.col("words"), F.col("words_2")), 6).alias("similarity"))


def _matchable(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({S.clean(c)}), '[^a-z0-9.\- ]+', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"


_PRESENT = ["red widget", "Brand#17", "smal", "brass rings", "ECONOMY.", "  ", "xyz", None, "bolt large"]
# Rows of the longest common subsequence: each from the row above, left to right.
_LCS = """list_reduce(list_concat([list_transform(range(len(w) + 1), lambda z: CAST(0 AS BIGINT))], list_transform(range(1, len(s) + 1), lambda i: [CAST(i AS BIGINT)])),
      lambda above, step: list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(range(1, len(w) + 1), lambda j: [CAST(j AS BIGINT)])),
        lambda done, spot: list_append(done, CASE WHEN substr(s, step[1], 1) = substr(w, spot[1], 1) THEN above[spot[1]] + 1 ELSE greatest(above[spot[1] + 1], done[spot[1]]) END)))[len(w) + 1]"""


@register.add(f"""WITH i AS (SELECT p_partkey, {S.case('p_partkey', _PRESENT)} AS value, p_name || ' of ' || lower(p_type) || ' ' || p_brand AS text FROM part),
    n AS (SELECT p_partkey, {_matchable('value')} AS v, {_matchable('text')} AS t FROM i),
    d AS (SELECT DISTINCT v, t, CASE WHEN length(v) <= length(t) THEN v ELSE t END AS s, CASE WHEN length(v) <= length(t) THEN t ELSE v END AS l FROM n WHERE v <> '' AND NOT contains(t, v)),
    w AS (SELECT v, t, s, substr(l, greatest(k, 1), least(k + length(s), length(l) + 1) - greatest(k, 1)) AS w FROM (SELECT *, unnest(range(2 - length(s), length(l) + 1)) AS k FROM d)),
    r AS (SELECT v, t, max(2.0 * {_LCS} / (length(s) + length(w))) AS ratio FROM w GROUP BY 1, 2)
    SELECT p_partkey, CASE WHEN v <> '' THEN CAST(contains(t, v) AS INT) END AS literal, CASE WHEN v = '' THEN NULL WHEN contains(t, v) THEN 1.0 ELSE round(ratio, 6) END AS presence FROM n LEFT JOIN r USING (v, t)""")
def partial_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a part's description holds a value, and how nearly."""
    value, text = F.expr(S.case("p_partkey", _PRESENT)), F.concat(F.col("p_name"), F.lit(" of "), F.lower("p_type"), F.lit(" "), F.col("p_brand"))
    forms = dealt(table(spark, sf, "part"), "p_partkey").select("p_partkey", similarity.matchable(value).alias("v"), similarity.matchable(text).alias("t"))
    v, t = F.col("v"), F.col("t")
    return forms.select("p_partkey", similarity.literal_of(v, t).alias("literal"), F.round(similarity.presence_of(v, t), 6).alias("presence"))


_SPOTS = "SELECT l_orderkey AS record, l_linenumber AS n, l_partkey, CAST(floor(l_quantity) AS BIGINT) AS q, l_partkey % 40 AS p, l_suppkey % 30 AS s FROM lineitem"


@register.add(f"""WITH m AS (SELECT record, min(n) AS n, p, s, l_partkey, q FROM ({_SPOTS}) GROUP BY ALL),
    x AS (SELECT DISTINCT record, l_partkey, p, s, q, unnest(list_concat(range(p, p + q), range(p + q + 5, p + q + 5 + s), CASE WHEN s > 20 THEN range(0, 9) ELSE [] END)) AS pixel FROM m),
    a AS (SELECT record, l_partkey, p, s, q, count(*) AS area FROM x GROUP BY ALL),
    b AS (SELECT x.record, x.l_partkey AS one, x.q AS q1, x.s AS s1, y.l_partkey AS two, y.q AS q2, y.s AS s2, count(*) AS common FROM x JOIN x y ON x.record = y.record AND x.pixel = y.pixel AND x.l_partkey < y.l_partkey GROUP BY ALL)
    SELECT b.record, one, two, q1, q2, s1, s2, common, round(common / (a.area + c.area - common), 6) AS iou, round(common / least(a.area, c.area), 6) AS contained FROM b
      JOIN a ON a.record = b.record AND a.l_partkey = one AND a.q = q1 AND a.s = s1 JOIN a c ON c.record = b.record AND c.l_partkey = two AND c.q = q2 AND c.s = s2""")
def mask_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of masks with holes, as runs of pixels, in each record."""
    rows = table(spark, sf, "lineitem").selectExpr("l_orderkey AS record", "l_partkey", "CAST(floor(l_quantity) AS BIGINT) AS q", "l_partkey % 40 AS p", "l_suppkey % 30 AS s").distinct()
    run = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"))
    p, q, s = F.col("p"), F.col("q"), F.col("s")
    nothing = F.lit(0)
    mask = F.array(run(p, p + q), run(p + q + 5, p + q + 5 + s), run(nothing, F.when(s > 20, 9).otherwise(0)))
    masks = rows.select("record", "l_partkey", "q", "s", geometry.mask_runs(mask).alias("runs")).withColumn("pixels", geometry.run_pixels(F.col("runs")))
    pairs = masks.alias("a").join(masks.alias("b"), "record").filter("a.l_partkey < b.l_partkey")

    def measured(s: Column) -> Column:
        """No row where nothing is shared: a filter would be pushed below and compute every share again."""
        return F.when(s["both"] > 0, F.array(F.struct(s["both"].alias("common"), F.round(geometry.mask_iou(s), 6).alias("iou"), F.round(geometry.mask_containment(s), 6).alias("contained"))))

    shares = geometry.run_shares(F.col("a.runs"), F.col("b.runs"), F.col("a.pixels"), F.col("b.pixels"))
    return pairs.select("record", F.col("a.l_partkey").alias("one"), F.col("b.l_partkey").alias("two"), F.col("a.q").alias("q1"), F.col("b.q").alias("q2"), F.col("a.s").alias("s1"), F.col("b.s").alias("s2"), F.inline(T.let(shares, measured)))


_LABELS = ["full database label", "Database:Number", "specimen_label", "barcode", " printed  label", "type", "stamp", "handwritten_data", "ruler", "annotation label"]
_REGIONS = f"""SELECT l_orderkey AS record, CAST(l_linenumber AS STRING) AS id, {S.case('l_partkey', _LABELS)} AS label, l_discount * 3 AS confidence, CASE l_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Label of ' || CAST(l_orderkey % 9 AS STRING) WHEN 2 THEN 'label, of: ' || CAST(l_orderkey % 9 AS STRING) || CAST(l_partkey % 7 AS STRING) WHEN 3 THEN 'E0063' || CAST(l_partkey % 11 AS STRING) ELSE 'Rosa canina ' || CAST(l_partkey % 2 AS STRING) END AS text,
      CASE WHEN l_suppkey % 4 = 0 THEN 'E00' || CAST(l_orderkey % 3 AS STRING) || '52' || CAST(l_partkey % 5 AS STRING) ELSE NULL END AS decoded, l_quantity AS utility, CASE WHEN l_tax > 0.06 THEN '{{"' || CAST(l_linenumber % 7 + 1 AS STRING) || '": 0.6}}' WHEN l_tax > 0.03 THEN '{{"' || CAST(l_linenumber % 7 + 1 AS STRING) || '": 0.2, "x": null}}' ELSE 'none' END AS masks,
      CAST(l_linenumber * 10 AS INT) AS x0, CAST(floor(l_quantity) AS INT) AS y0, CAST(l_linenumber * 10 + 20 + l_partkey % 40 AS INT) AS x1, CAST(floor(l_quantity) AS INT) + CAST(20 + l_suppkey % 40 AS INT) AS y1 FROM lineitem""".replace("{{", "{").replace("}}", "}")
_PLACE = "row_number() OVER (PARTITION BY record ORDER BY utility DESC, id, x0, y0, x1, y1, label NULLS FIRST, text NULLS FIRST, decoded NULLS FIRST)"


def _said(decoded: str = "decoded", text: str = "text") -> str:
    return f"CASE WHEN {S.clean(decoded)} <> '' THEN {S.clean(decoded)} ELSE {S.clean(text)} END"


def _duplicates(source: str, name: str) -> str:
    """CTEs: `name`_hits (record, place, earlier, earlier_id, reason) of a source with place, role and said."""
    side = lambda s: f"greatest({s}.x1 - {s}.x0, 0) * greatest({s}.y1 - {s}.y0, 0)"
    mask = lambda s, o: f"(CASE WHEN {s}.masks <> 'none' THEN coalesce(TRY_CAST({s}.masks ->> ('$.\"' || {o}.id || '\"') AS DOUBLE), 0) ELSE 0 END)"
    return f"""{name}_pairs AS (SELECT a.record, a.place, b.place AS earlier, b.id AS earlier_id, a.role = b.role AS same_role, {S.alnum('a.said')} AS ka, {S.alnum('b.said')} AS kb, greatest({mask('a', 'b')}, {mask('b', 'a')}) AS mask,
        greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS shared, {side('a')} AS s1, {side('b')} AS s2
        FROM {source} a JOIN {source} b ON a.record = b.record AND a.place > b.place
        WHERE NOT (list_contains([a.role, b.role], 'identifier_parent') AND list_contains([a.role, b.role], 'identifier_child')) AND NOT (a.role <> b.role AND list_contains([a.role, b.role], 'primary_label'))),
    {name}_measured AS (SELECT *, CASE WHEN s1 + s2 - shared > 0 THEN shared / (s1 + s2 - shared) ELSE 0 END AS iou, CASE WHEN least(s1, s2) > 0 THEN shared / least(s1, s2) ELSE 0 END AS contained FROM {name}_pairs WHERE shared > 0 OR mask > 0),
    {name}_judged AS (SELECT *, same_role AND (iou >= 0.45 OR contained >= 0.85 OR mask >= 0.45) AS one_place, contained >= 0.85 OR iou >= 0.25 AS near FROM {name}_measured),
    {name}_asked AS (SELECT DISTINCT ka, kb FROM {name}_judged WHERE NOT one_place AND near AND ka <> '' AND kb <> ''),
    {S.matching_ratio(f'{name}_asked', 'ka', 'kb', f'{name}_ratio')},
    {name}_hits AS (SELECT record, place, earlier, earlier_id, CASE WHEN one_place THEN 'same_role_geometry_duplicate' WHEN near AND coalesce(ratio, 0) >= 0.85 THEN 'same_text_cross_class_duplicate' WHEN iou >= 0.75 THEN 'high_iou_class_conflict' END AS reason
        FROM {name}_judged LEFT JOIN {name}_ratio ON a = ka AND b = kb)"""


def _settled(source: str, name: str) -> str:
    """CTEs: `name`_gone (record, place, reason, of), by going through each record in order."""
    return f"""{name}_steps AS (SELECT record, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone FROM {source} GROUP BY record
      UNION ALL SELECT s.record, r.place, CASE WHEN EXISTS (SELECT 1 FROM {name}_hits h WHERE h.record = r.record AND h.place = r.place AND h.reason IS NOT NULL AND NOT list_contains(s.gone, h.earlier)) THEN list_append(s.gone, r.place) ELSE s.gone END
      FROM {name}_steps s JOIN {source} r ON r.record = s.record AND r.place = s.k + 1),
    {name}_last AS (SELECT record, arg_max(gone, k) AS gone FROM {name}_steps GROUP BY record),
    {name}_gone AS (SELECT h.record, h.place, arg_min(h.reason, h.earlier) AS reason, arg_min(h.earlier_id, h.earlier) AS "of" FROM {name}_hits h JOIN {name}_last l ON l.record = h.record
      WHERE h.reason IS NOT NULL AND list_contains(l.gone, h.place) AND NOT list_contains(l.gone, h.earlier) GROUP BY 1, 2)"""


_KINDS = f"(SELECT *, {S.component_type('label')} AS kind FROM ({_REGIONS}))"


@register.add(f"""WITH RECURSIVE r AS (SELECT *, {S.role('kind')} AS role, {_said()} AS said, {_PLACE} AS place FROM {_KINDS}),
    {_duplicates('r', 'd')}, {_settled('r', 'd')}
    SELECT r.record, CAST(r.place AS INT) AS place, r.id, coalesce(g.reason, '') AS duplicate_reason, coalesce(g."of", '') AS duplicate_of FROM r LEFT JOIN d_gone g ON g.record = r.record AND g.place = r.place""")
def deduplicated_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of each record without those that duplicate a better one, and why."""
    done = crops.deduplicated(_regions(spark, sf))
    return done.select("record", "place", "id", "duplicate_reason", "duplicate_of")


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    source = _REGIONS.removeprefix("SELECT ").removesuffix(" FROM lineitem")
    # Dealt by record as they are read, while rows are a few numbers; nothing below needs another exchange of regions.
    rows = dealt(table(spark, sf, "lineitem"), "l_orderkey")
    rows.createOrReplaceTempView("_regions_lineitem")
    return spark.sql(f"SELECT {source} FROM _regions_lineitem").withColumn("overlaps", geometry.overlap_texts(F.col("masks")))


_REFERENCE = {
    "catalogNumber": "'E0063' || CAST(o_orderkey % 11 AS STRING)", "scientificName": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Rosa canina' END", "recordedBy": "'Lahti'", "eventDate": "CASE WHEN o_orderkey % 2 = 0 THEN '1921' END",
    "country": "'Cuba'", "stateProvince": "''", "decimalLatitude": "'5' || CAST(o_orderkey % 5 AS STRING)", "decimalLongitude": "NULL", "typeStatus": "'label'",
}
_CHOICE = f"""gated AS (SELECT *, {S.role('kind')} AS role, {_said()} AS said FROM {_KINDS}),
    passing AS (SELECT *, CASE WHEN role = 'other' THEN 'unsupported_component_type' WHEN confidence < {S.looked_up(R.THRESHOLDS, 'kind', '0.10')} THEN 'below_class_threshold' WHEN said <> '' THEN 'direct_text_evidence'
        WHEN role IN ('primary_label', 'annotation') AND confidence >= 0.20 THEN 'vision_only_high_confidence' ELSE 'empty_evidence' END AS gate FROM gated),
    r AS (SELECT *, {_PLACE} AS place FROM passing WHERE gate IN ('direct_text_evidence', 'vision_only_high_confidence'))"""
_QUOTA = "CASE role WHEN 'identifier_child' THEN 3 ELSE 2 END"
_TURN = "CASE role WHEN 'primary_label' THEN 0 WHEN 'identifier_child' THEN 1 WHEN 'identifier_parent' THEN 2 ELSE 3 END"


def _hit(field: str) -> str:
    """Only a whole date of year and month has variants, and the references have none."""
    return f"({field} <> '' AND coalesce({S.alnum('evidence')} <> '' AND contains({S.alnum('evidence')}, {S.alnum(field)}), FALSE))"


_COUNTED = f"""{_CHOICE}, {_duplicates('r', 'd')}, {_settled('r', 'd')},
    single AS (SELECT 'all' AS branch, * FROM r UNION ALL SELECT 'hierarchical', r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM d_gone g WHERE g.record = r.record AND g.place = r.place)),
    in_role AS (SELECT *, row_number() OVER (PARTITION BY branch, record, role ORDER BY utility DESC, place) AS k FROM single),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY branch, record ORDER BY CASE WHEN k = 1 THEN {_TURN} ELSE 4 END, utility DESC, place) AS input_order FROM in_role WHERE k <= {_QUOTA}),
    chosen AS (SELECT branch, record, input_order, id, role, said, masks, x0, y0, x1, y1, branch || '/' || record AS packet FROM ordered WHERE input_order <= 8),
    c AS (SELECT packet AS record, input_order AS place, id, role, said, masks, x0, y0, x1, y1 FROM chosen),
    {_duplicates('c', 'e')},
    twins AS (SELECT record AS packet, count(*) AS n FROM e_hits WHERE reason IS NOT NULL GROUP BY 1),
    packets AS (SELECT branch, record, packet, count(*) AS images, count(*) FILTER (WHERE said <> '') AS usable, count(DISTINCT CASE WHEN {S.alnum('said')} <> '' THEN {S.alnum('said')} END) AS different,
      string_agg(CASE WHEN said <> '' THEN said END, chr(10) || 'EVIDENCE_BOUNDARY' || chr(10) ORDER BY input_order) AS evidence FROM chosen GROUP BY ALL),
    refs AS (SELECT o_orderkey AS record, {', '.join(f"coalesce({v}, '') AS {k}" for k, v in _REFERENCE.items())} FROM orders),
    wide AS (SELECT b.branch, f.*, coalesce(images, 0) AS images, coalesce(usable, 0) AS usable, coalesce(different, 0) AS different, evidence, coalesce(t.n, 0) AS twins FROM (SELECT 'all' AS branch UNION ALL SELECT 'hierarchical') b CROSS JOIN refs f LEFT JOIN packets p ON p.branch = b.branch AND p.record = f.record LEFT JOIN twins t ON t.packet = p.packet),
    counted AS (SELECT *, {' + '.join(f"CAST({k} <> '' AS BIGINT)" for k in _REFERENCE)} AS known, {' + '.join(f'CAST({_hit(k)} AS BIGINT)' for k in _REFERENCE)} AS hits, {_hit('catalogNumber')} AS catalog_hit FROM wide)"""


@register.add(f"""WITH RECURSIVE {_COUNTED},
    refused AS (SELECT count(*) FILTER (WHERE gate NOT IN ('direct_text_evidence', 'vision_only_high_confidence')) AS evidence, count(*) AS candidates FROM passing SEMI JOIN refs USING (record)),
    gone AS (SELECT count(*) AS n FROM d_gone SEMI JOIN refs USING (record)), good AS (SELECT count(*) AS n FROM r SEMI JOIN refs USING (record))
    SELECT branch, count(*) AS record_count, CAST(any_value(candidates) AS BIGINT) AS candidate_count, CAST(sum(images) AS BIGINT) AS selected_crop_count, round(sum(images) / count(*), 4) AS mean_input_images_per_record, count(*) FILTER (WHERE images = 0) AS records_without_input,
      round(avg(CAST(catalog_hit AS DOUBLE)), 4) AS catalog_number_evidence_hit_rate, CAST(sum(known) AS BIGINT) AS field_reference_count, CAST(sum(hits) AS BIGINT) AS field_evidence_hit_count, round(sum(hits) / sum(known), 4) AS field_evidence_hit_rate, round(sum(usable) / sum(images), 4) AS selected_crop_ocr_usable_rate,
      round(avg(CASE WHEN usable > 0 THEN round(different / usable, 6) ELSE 0 END), 4) AS mean_text_uniqueness_rate, CAST(sum(twins) AS BIGINT) AS selected_duplicate_pair_count, CAST(any_value(refused.evidence) AS BIGINT) AS evidence_rejection_count, CASE WHEN branch = 'all' THEN 0 ELSE any_value(gone.n) END AS dedup_rejection_count,
      CAST(any_value(good.n) - CASE WHEN branch = 'all' THEN 0 ELSE any_value(gone.n) END - sum(images) AS BIGINT) AS quota_rejection_count FROM counted, refused, gone, good GROUP BY branch""")
def crop_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Two ways of choosing regions, compared by what their packets hold."""
    return _tables(spark, sf)["branches"]


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    regions = _regions(spark, sf)
    branches = {"all": False, "hierarchical": True}
    decisions = crops.choose_each(regions, branches, with_pairs=True)
    references = dealt(table(spark, sf, "orders"), "o_orderkey").selectExpr("o_orderkey AS record", *(f"{v} AS {k}" for k, v in _REFERENCE.items()))
    return crops.tables(decisions, references, branches=list(branches))


@register.add(f"""WITH RECURSIVE {_COUNTED}, f AS ({' UNION ALL '.join(f"SELECT branch, '{k}' AS field, {k} <> '' AS known, {_hit(k)} AS hit FROM wide" for k in _REFERENCE)})
    SELECT branch, field, count(*) FILTER (WHERE known) AS reference_available_count, count(*) FILTER (WHERE hit) AS evidence_hit_count, CASE WHEN count(*) FILTER (WHERE known) > 0 THEN round(count(*) FILTER (WHERE hit) / count(*) FILTER (WHERE known), 4) ELSE 0 END AS evidence_hit_rate FROM f GROUP BY 1, 2""")
def crop_field_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How often each field's value stands in the packets of each branch."""
    return _tables(spark, sf)["field_summary"]


@register.add(f"""WITH RECURSIVE {_COUNTED}, refused AS (SELECT record, count(*) AS n, count(*) FILTER (WHERE gate IN ('direct_text_evidence', 'vision_only_high_confidence')) AS good FROM passing GROUP BY 1)
    SELECT branch, c.record, coalesce(n, 0) AS candidate_count, coalesce(good, 0) AS evidence_accepted_count, images AS input_image_count, usable AS ocr_usable_crop_count, different AS unique_text_count, CAST(twins AS BIGINT) AS selected_duplicate_pair_count, CASE WHEN images > 0 THEN round(usable / images, 6) ELSE 0 END AS ocr_usable_rate,
      CASE WHEN usable > 0 THEN round(different / usable, 6) ELSE 0 END AS text_uniqueness_rate, known AS reference_field_count, hits AS field_evidence_hit_count, CASE WHEN known > 0 THEN round(hits / known, 6) ELSE 0 END AS field_evidence_hit_rate, catalog_hit AS catalog_number_evidence_hit FROM counted c LEFT JOIN refused r ON r.record = c.record""")
def crop_records(spark: SparkSession, sf: str) -> DataFrame:
    """What each branch's packet of each record holds."""
    return _tables(spark, sf)["records"]
