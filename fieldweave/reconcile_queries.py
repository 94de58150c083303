"""Registered queries on reconciled fields, hybrid ranking and the reference corpus, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import text as T
from .operators import reconcile, retrieval, sets
from .registry import Register
from .sources.files import table

register = Register()

_REGION = "role || '-' || turn // 2"
_FIELDS = """f AS (SELECT conv_id, 'field' || turn AS field, substr(text, 3, 12) AS value, CASE turn % 4 WHEN 1 THEN 'not in any text' WHEN 2 THEN '' ELSE substr(text, 3, 12) END AS span,
    CASE WHEN turn % 5 = 4 THEN 'nowhere' ELSE role || '-' || turn // 2 END AS source, CASE turn % 3 WHEN 0 THEN '1.5' WHEN 1 THEN 'high' ELSE '0.25' END AS confidence, turn % 7 = 3 AS review, CASE WHEN turn % 6 = 0 THEN 'other' ELSE ' ' END AS alt FROM conversations)"""


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("region", F.concat_ws("-", "role", F.floor(F.col("turn") / 2)))


def _fields(spark: SparkSession, sf: str) -> DataFrame:
    turn, said = F.col("turn"), F.substring("text", 3, 12)
    span = F.when(turn % 4 == 1, "not in any text").when(turn % 4 == 2, "").otherwise(said)
    sure = F.when(turn % 3 == 0, "1.5").when(turn % 3 == 1, "high").otherwise("0.25")
    return _readings(spark, sf).select(
        "conv_id", F.concat(F.lit("field"), turn).alias("field"), said.alias("value"), span.alias("span"), F.when(turn % 5 == 4, "nowhere").otherwise(F.col("region")).alias("source"),
        sure.alias("confidence"), (turn % 7 == 3).alias("review"), F.array(F.when(turn % 6 == 0, "other").otherwise(" ")).alias("alternatives"),
    )


_VALID = f"""{_FIELDS}, t AS (SELECT conv_id, {_REGION} AS source, string_agg({S.clean('text')}, chr(10) ORDER BY turn, text) FILTER (WHERE {S.clean('text')} <> '') AS body FROM conversations GROUP BY 1, 2),
    j AS (SELECT f.conv_id, field, {S.clean('value')} AS value, greatest(least(coalesce(TRY_CAST(confidence AS DOUBLE), 0), 1), 0) AS sure, {S.clean('span')} AS span, f.source, review, {S.clean('alt')} AS alt, coalesce({S.clean('span')} <> '' AND contains(lower(body), lower({S.clean('span')})), false) AS held FROM f LEFT JOIN t USING (conv_id, source)),
    v AS (SELECT *, value <> '' AND NOT held AS unsupported FROM j)"""


@register.add(f"""WITH {_VALID} SELECT conv_id, field, CASE WHEN unsupported THEN '' ELSE value END AS value, CASE WHEN unsupported THEN 0.0 ELSE sure END::DOUBLE AS confidence, CASE WHEN unsupported THEN '' ELSE span END AS span, CASE WHEN unsupported THEN '' ELSE source END AS source,
    CASE WHEN unsupported THEN '' ELSE alt END AS alternatives, unsupported, review OR unsupported OR alt <> '' AS review FROM v""")
def validated_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of records held against the regions they name."""
    regions = reconcile.region_texts(_readings(spark, sf), "conv_id", "region", "turn", "text")
    return reconcile.validated(_fields(spark, sf), regions, "conv_id", "region").withColumn("alternatives", F.array_join("alternatives", ";"))


@register.add(f"""WITH {_VALID}, r AS (SELECT conv_id, max(CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN 'B-' || conv_id ELSE {S.clean('value')} END) AS resolved, conv_id % 5 = 0 AS asks FROM f WHERE field = 'field0' GROUP BY 1, 3),
    o AS (SELECT v.*, CASE WHEN unsupported THEN '' ELSE value END AS own, CASE WHEN field = 'field0' AND resolved <> '' THEN resolved END AS better, asks FROM v LEFT JOIN r USING (conv_id)), d AS (SELECT *, better IS NOT NULL AND own <> '' AND {S.identifier('own')} <> {S.identifier('better')} AS differs FROM o)
    SELECT conv_id, field, coalesce(better, own) AS value, CASE WHEN differs THEN own WHEN better IS NOT NULL OR unsupported THEN '' ELSE alt END AS alternatives, CASE WHEN better IS NOT NULL THEN asks OR differs ELSE review OR unsupported OR alt <> '' END AS review FROM d""")
def overridden_fields(spark: SparkSession, sf: str) -> DataFrame:
    """A resolved value in place of a field's own."""
    fields, conv = _fields(spark, sf), F.col("conv_id")
    regions = reconcile.region_texts(_readings(spark, sf), "conv_id", "region", "turn", "text")
    made = F.when(conv % 3 == 0, "").when(conv % 3 == 1, F.concat(F.lit("B-"), conv)).otherwise(T.clean(F.col("value")))
    resolved = fields.filter("field = 'field0'").select("conv_id", made.alias("value"), (conv % 5 == 0).alias("review"))
    done = reconcile.overridden(reconcile.validated(fields, regions, "conv_id", "region"), resolved, "conv_id", "field0")
    return done.select("conv_id", "field", "value", F.array_join("alternatives", ";").alias("alternatives"), "review")


@register.add(f"""WITH f AS (SELECT conv_id, turn AS field, substr(text, 1, 1 + turn % 4) AS value, replace(substr(text, 1, 1 + turn % 4), 'D', 'd') AS span FROM conversations),
    r AS (SELECT conv_id, {_REGION} AS source, turn, lower({S.clean('text')}) AS body, role || turn % 2 AS engine FROM conversations),
    h AS (SELECT f.conv_id, field, r.source, min(turn) AS first, string_agg(DISTINCT r.source || ':' || engine, ';' ORDER BY r.source || ':' || engine) AS supporting FROM f JOIN r USING (conv_id) WHERE {S.clean('value')} <> '' AND {S.clean('span')} <> '' AND contains(body, lower({S.clean('span')})) GROUP BY 1, 2, 3),
    b AS (SELECT conv_id, field, arg_min(source, (first, source)) AS source, arg_min(supporting, (first, source)) AS supporting FROM h GROUP BY 1, 2)
    SELECT conv_id, field, value, coalesce(source, '') AS source, coalesce(supporting, '') AS supporting FROM f LEFT JOIN b USING (conv_id, field)""")
def attributed_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values with the first region that holds their evidence, and its readings that do."""
    said = F.col("text").substr(F.lit(1), (1 + F.col("turn") % 4).cast("int"))
    rows = _readings(spark, sf)
    values = rows.select("conv_id", F.col("turn").alias("field"), said.alias("value"), F.replace(said, F.lit("D"), F.lit("d")).alias("span"))
    readings = rows.withColumn("engine", F.concat("role", F.col("turn") % 2))
    return reconcile.attributed(values, readings, "conv_id", "region", "turn", "text", "engine").select("conv_id", "field", "value", "source", F.array_join("supporting", ";").alias("supporting"))


@register.add("""SELECT 'field_guide' AS source, '' AS key, text FROM benchmark WHERE item_id % 4 = 0 UNION ALL SELECT 'demo_example', CAST(c_custkey AS VARCHAR), 'c_name: ' || coalesce(c_name, '') || ' | c_mktsegment: ' || coalesce(c_mktsegment, '') || ' | c_nationkey: ' || coalesce(CAST(c_nationkey AS VARCHAR), '') FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'authority_cache', '', n_name FROM nation""")
def reference_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """References of guides, examples and authority texts, none of which evaluation holds."""
    customers = table(spark, sf, "customer")
    examples = sets.assert_no_leak(customers.filter("c_custkey % 2 = 0"), customers.filter("c_custkey % 2 = 1"), "c_custkey")
    guides, names = table(spark, sf, "benchmark").filter("item_id % 4 = 0"), table(spark, sf, "nation").select(F.col("n_name").alias("text"))
    return sets.reference_corpus(guides, examples, names, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@register.add("""SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS c_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'""")
def leaked_references(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that references and evaluation share."""
    asked = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("c_custkey"))
    return sets.leaked(table(spark, sf, "customer"), asked, "c_custkey")


_TOKENS = "unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@register.add(f"""WITH c AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS v, text, coalesce(source, '') AS g FROM embeddings JOIN documents ON doc_id = vec_id), m AS (SELECT count(*) + 1 AS m FROM c),
    d AS (SELECT doc, term, count(*) AS n FROM (SELECT doc, {_TOKENS} AS term FROM c) GROUP BY 1, 2), q AS (SELECT doc AS query, term, n FROM d WHERE doc % 20 = 0), f AS (SELECT term, count(*) AS df FROM d GROUP BY 1),
    dw AS (SELECT doc, term, n, n * (ln((1.0 + m) / (1.0 + df)) + 1) AS plain, n * (ln((1.0 + m) / (2.0 + df)) + 1) AS asked FROM d JOIN f USING (term), m), qw AS (SELECT query, term, q.n, q.n * (ln((1.0 + m) / (2.0 + df)) + 1) AS w FROM q JOIN f USING (term), m),
    qn AS (SELECT query, sum(w * w) AS s, sum(n * n) AS l FROM qw GROUP BY 1), dn AS (SELECT doc, sum(plain * plain) AS s, sum(n * n) AS l FROM dw GROUP BY 1),
    p AS (SELECT query, doc, sum(w * asked) AS dot, sum(asked * asked - plain * plain) AS shift, sum(qw.n * dw.n) AS plain_dot FROM qw JOIN dw USING (term) GROUP BY 1, 2),
    t AS (SELECT query, doc, (round(dot / sqrt(qn.s * (dn.s + shift)), 6) + round(plain_dot / (sqrt(qn.l) * sqrt(dn.l)), 6)) / 2 AS t FROM p JOIN qn USING (query) JOIN dn USING (doc)),
    a AS (SELECT x.doc AS query, y.doc, round(list_dot_product(x.v, y.v), 5) AS visual_similarity, round(coalesce(t, 0), 7)::DOUBLE AS text_similarity, CAST(x.g <> '' AND x.g = y.g AS INT)::DOUBLE AS group_bonus FROM c x JOIN c y ON x.doc % 20 = 0 AND x.doc <> y.doc LEFT JOIN t ON t.query = x.doc AND t.doc = y.doc),
    s AS (SELECT *, round(0.45::DOUBLE * visual_similarity + 0.45::DOUBLE * text_similarity + 0.1::DOUBLE * group_bonus, 9) AS score FROM a)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM s) WHERE rank <= 3""")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three rows best by vector, words and group together, for a stated set of queries against all rows."""
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source")
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").join(texts, "vec_id")
    return retrieval.hybrid(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "embedding", "text", "source", 3)
