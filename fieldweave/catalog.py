"""Registered queries of the library: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import authority_queries, comparison_queries, crop_queries, evaluation_queries, field_queries, file_queries, reconcile_queries, records, relation_queries
from .functions import fields as R
from .functions import text as T
from .operators import evaluate, evidence, geometry, graph, retrieval, splits
from .plans import gates
from .sources.files import table
from .streaming import windows


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Two methods' predictions of a document's first twelve words, with the document as evidence."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("record"), "lang", F.coalesce("text", F.lit("")).alias("evidence_text"))
    docs = evaluate.prepared(docs)
    first = lambda n: F.array_join(F.slice(F.split("evidence_text", "[ \n]"), 1, n), " ")
    rule = F.struct(F.lit("rule").alias("method"), F.lower(first(8)).alias("pred"))
    model = F.struct(F.lit("model").alias("method"), F.when(F.col("record") % 7 == 0, "").otherwise(F.replace(first(12), F.lit(","), F.lit(""))).alias("pred"))
    rows = docs.select("record", "lang", "evidence_normal", "evidence_words", first(12).alias("gold"), F.inline(F.array(rule, model)))
    return evaluate.detail(rows)


def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summary(_evaluated(spark, sf), "method")


def eval_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.summary(_evaluated(spark, sf), "method", "lang")


def eval_gates(spark: SparkSession, sf: str) -> DataFrame:
    one = evaluate.summary(_evaluated(spark, sf)).withColumnRenamed("n", "rows")
    return gates.check(one, [("coverage", ">=", 0.95), ("exact_match", ">=", 0.2), ("token_f1", ">=", 0.25), ("evidence", ">=", 0.9)])


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_eval(F.col("text")).alias("normal"))


def normalize_ids(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit(" e-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit(" / "), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", T.identifier_key(raw).alias("identifier"), T.alnum_key(raw).alias("alnum"), T.person_key(F.col("c_name")).alias("person"))


def type_status(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["Isolectotype of X", "HOLOTYPE", "a type sheet", "Paratype!", "none", "unknown"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.type_status(kind).alias("status"))


def rule_extract(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.lit("Sheet e "), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(" coll. "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", F.upper(R.identifier_in(label)).alias("catalog_number"), R.date_in(label).alias("event_date"))


def ordered_text_agg(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.ordered_text(table(spark, sf, "conversations"), "conv_id", "turn", "text")


def consensus(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.consensus(table(spark, sf, "events"), "user_id", "event_type", "event_id")


def topk_regions(spark: SparkSession, sf: str) -> DataFrame:
    best = evidence.top_k(table(spark, sf, "lineitem"), "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber")], 3)
    return best.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 2).alias("price"), "rank")


def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return splits.summary(splits.assign(table(spark, sf, "documents"), "doc_id", 42), "split", "source")


def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    return splits.leaks(splits.assign(table(spark, sf, "documents"), "doc_id", 42), F.sha2("text", 256), "demo", "eval", "doc_id")


def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("query"), "text")
    return retrieval.lexical(asked, table(spark, sf, "benchmark").select(F.col("item_id").alias("doc"), "text"), 3)


def box_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.suppress(_boxes(spark, sf), "record")


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    x0, y0 = F.col("l_linenumber") * 10, F.col("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("label"), F.col("l_discount").alias("confidence"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_partkey") % 40).cast("int").alias("x1"), (y0 + 20 + F.col("l_suppkey") % 40).cast("int").alias("y1"),
    )


def box_iou(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf).select("record", "id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    a, b = F.col("a.box"), F.col("b.box")
    # Corners first: most pairs are told apart by four comparisons. The rest must reach half a millionth, in whole numbers.
    met = (F.col("a.record") == F.col("b.record")) & (F.col("a.id") < F.col("b.id")) & geometry.touching(a, b)
    pairs = boxes.alias("a").join(boxes.alias("b"), met).filter(geometry.reaches_millionth(a, b))
    return pairs.select(F.col("a.record").alias("record"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), geometry.iou_millionths(a, b).alias("iou"))


def graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    nations = F.broadcast(table(spark, sf, "nation"))  # 25 rows at any scale
    rows = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    customer, nation = ("Customer", F.col("c_custkey")), ("Nation", F.col("n_name"))
    return graph.edges(rows, customer, "IN_NATION", nation).unionByName(graph.edges(rows, customer, "IN_SEGMENT", ("Segment", F.col("c_mktsegment"))))


def usage_by_status(spark: SparkSession, sf: str) -> DataFrame:
    used = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(used).cast("long").alias("units"), F.count_if(used > 50).alias("heavy"), F.round(F.avg("value"), 6).alias("mean_value"))


def hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return windows.counts(table(spark, sf, "events"), "ts", "event_type", "1 hour", "10 minutes")


def paired_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.deltas(_evaluated(spark, sf), "rule", "model", "lang")


def normalize_dates(spark: SparkSession, sf: str) -> DataFrame:
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "dd/MM/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy"]
    written = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        written = F.when(F.col("o_orderkey") % 9 == i, F.date_format("o_orderdate", form)).otherwise(written)
    return table(spark, sf, "orders").select("o_orderkey", T.event_date(F.concat(F.lit(" "), written, F.lit(". "))).alias("event_date"))


def json_repair(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit("The answer: "), "props", F.lit(" as asked."))).when(kind == 2, F.col("props")).otherwise("no object")
    return table(spark, sf, "events").select("event_id", F.get_json_object(T.json_body(answer), "$.k").try_cast("long").alias("k"))


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified(table(spark, sf, "documents"), "doc_id", "source", 100, 42)


def tertiles(spark: SparkSession, sf: str) -> DataFrame:
    return splits.tertiles(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "tertile")


def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "documents").select(F.col("doc_id").alias("query"), "text")
    return retrieval.tfidf(asked, table(spark, sf, "benchmark").select(F.col("item_id").alias("doc"), "text"), 3)


def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    read = table(spark, sf, "lineitem").withColumn("reading", F.concat(F.when(F.col("l_linenumber") % 2 == 0, "E-").otherwise("e "), (F.col("l_suppkey") % 3).cast("string")))
    return evidence.ranked_candidates(read, "l_orderkey", T.identifier_key(F.col("reading")), "reading", "l_returnflag", "l_linenumber")


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s.\-]', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"


def _clean(c: str) -> str:
    x = rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"
    return f"(CASE WHEN lower({x}) IN ('nan', 'none', 'null') THEN '' ELSE {x} END)"


def _normal(c: str) -> str:
    return _NORMAL.format(c=_clean(c))


_EVAL_SQL = f"""
WITH docs AS (SELECT doc_id AS record, lang, coalesce(text, '') AS ev, string_split_regex(coalesce(text, ''), '[ \\n]') AS w FROM documents),
pairs AS (
  SELECT record, lang, ev, array_to_string(w[1:12], ' ') AS gold, 'rule' AS method, lower(array_to_string(w[1:8], ' ')) AS pred FROM docs
  UNION ALL
  SELECT record, lang, ev, array_to_string(w[1:12], ' '), 'model', CASE WHEN record % 7 = 0 THEN '' ELSE replace(array_to_string(w[1:12], ' '), ',', '') END FROM docs),
normal AS (SELECT *, {_clean("pred")} <> '' AS filled, {_clean("gold")} <> '' AS evaluable, {_normal("pred")} AS p, {_normal("gold")} AS g, {_normal("ev")} AS e FROM pairs),
bags AS (SELECT *, list_filter(string_split(p, ' '), lambda x: x <> '') AS pw, list_filter(string_split(g, ' '), lambda x: x <> '') AS gw, list_filter(string_split(e, ' '), lambda x: x <> '') AS ew FROM normal),
detail AS (
  SELECT *, CASE WHEN evaluable THEN CAST(filled AS INT) END AS coverage, CASE WHEN evaluable THEN CAST(p = g AS INT) END AS exact_match,
    CASE WHEN evaluable THEN CASE WHEN len(pw) = 0 AND len(gw) = 0 THEN 1.0 WHEN len(pw) = 0 OR len(gw) = 0 THEN 0.0
      ELSE 2.0 * list_sum(list_transform(list_distinct(pw), lambda t: least(len(list_filter(pw, lambda x: x = t)), len(list_filter(gw, lambda x: x = t))))) / (len(pw) + len(gw)) END END AS token_f1,
    CASE WHEN p = '' THEN NULL WHEN e = '' THEN 0.0 WHEN contains(e, p) THEN 1.0 ELSE len(list_intersect(list_distinct(pw), ew)) / len(list_distinct(pw)) END AS evidence
  FROM bags),
"""
_SCORES = "round(avg(coverage), 6) AS coverage, round(avg(exact_match), 6) AS exact_match, round(avg(token_f1), 6) AS token_f1, round(avg(evidence), 6) AS evidence"
_BOXES_SQL = """boxes AS (SELECT l_orderkey AS record, l_linenumber AS id, l_linenumber * 10 AS x0, CAST(floor(l_quantity) AS INT) AS y0,
  l_linenumber * 10 + 20 + l_partkey % 40 AS x1, CAST(floor(l_quantity) AS INT) + 20 + l_suppkey % 40 AS y1 FROM lineitem)"""
_SPLIT_SQL = "CASE WHEN sha256(doc_id || '|42')[1] IN ('0', '1') THEN 'demo' WHEN sha256(doc_id || '|42')[1] IN ('2', '3', '4') THEN 'eval' ELSE 'rest' END"
_RAW_ID = "(' e-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || ' / ' || c_mktsegment)"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same columns; suppression of boxes is a recursion over their order."""
    one = _EVAL_SQL + f"one AS (SELECT {_SCORES} FROM detail) "
    gate = lambda c, x: f"SELECT '{c}' AS gate, '>=' AS operator, CAST({x} AS DOUBLE) AS threshold, CAST({c} AS DOUBLE) AS value, {c} >= {x} AS passed FROM one"
    tokens = "unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))"
    return {
        "eval_summary": _EVAL_SQL + f"x AS (SELECT 1) SELECT method, {_SCORES}, count(*) FILTER (WHERE evaluable) AS n FROM detail GROUP BY method",
        "eval_stratified": _EVAL_SQL + f"x AS (SELECT 1) SELECT method, lang, {_SCORES}, count(*) FILTER (WHERE evaluable) AS n FROM detail GROUP BY method, lang",
        "eval_gates": one + " UNION ALL ".join(gate(*g) for g in (("coverage", 0.95), ("exact_match", 0.2), ("token_f1", 0.25), ("evidence", 0.9))),
        "normalize_text": f"SELECT doc_id, {_normal('text')} AS normal FROM documents",
        "normalize_ids": f"SELECT c_custkey, upper(regexp_replace({_RAW_ID}, '[^A-Za-z0-9]+', '', 'g')) AS identifier, regexp_replace(lower({_RAW_ID}), '[^a-z0-9]+', '', 'g') AS alnum, array_to_string(list_sort(regexp_extract_all(lower(c_name), '[a-zà-öø-ÿ0-9]+')), ' ') AS person FROM customer",
        "type_status": "SELECT p_partkey, ['isolectotype', 'holotype', 'type', 'paratype', '', 'unknown'][p_partkey % 6 + 1] AS status FROM part",
        "rule_extract": "SELECT o_orderkey, 'E' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS catalog_number, strftime(o_orderdate, '%Y-%m-%d') AS event_date FROM orders",
        "ordered_text_agg": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id",
        "consensus": "WITH v AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, first(event_type ORDER BY c DESC, f) AS consensus, CAST(sum(c) AS BIGINT) AS repeats, CASE WHEN sum(c) > 1 THEN round(sum(c * (c - 1)) / (sum(c) * (sum(c) - 1)), 6) ELSE 1.0 END AS agreement FROM v GROUP BY user_id",
        "topk_regions": "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS price, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3",
        "split_summary": f"SELECT {_SPLIT_SQL} AS split, source, count(*) AS n FROM documents GROUP BY 1, 2",
        "leakage_check": f"WITH s AS (SELECT doc_id, text, {_SPLIT_SQL} AS split FROM documents) SELECT doc_id FROM s WHERE split = 'eval' AND sha256(text) IN (SELECT sha256(text) FROM s WHERE split = 'demo')",
        "lexical_topk": f"""WITH q AS (SELECT query, term, count(*) AS n FROM (SELECT doc_id AS query, {tokens} AS term FROM documents) GROUP BY 1, 2),
            d AS (SELECT doc, term, count(*) AS n FROM (SELECT item_id AS doc, {tokens} AS term FROM benchmark) GROUP BY 1, 2),
            qn AS (SELECT query, sqrt(sum(n * n)) AS m FROM q GROUP BY 1), dn AS (SELECT doc, sqrt(sum(n * n)) AS m FROM d GROUP BY 1),
            s AS (SELECT query, doc, round(sum(q.n * d.n) / (any_value(qn.m) * any_value(dn.m)), 6) AS score FROM q JOIN d USING (term) JOIN qn USING (query) JOIN dn USING (doc) GROUP BY 1, 2),
            a AS (SELECT doc_id AS query, item_id AS doc, coalesce(score, 0) AS score FROM documents CROSS JOIN benchmark LEFT JOIN s ON s.query = doc_id AND s.doc = item_id)
            SELECT query, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM a) WHERE rank <= 3""",
        "box_iou": f"""WITH {_BOXES_SQL}, p AS (SELECT a.record, a.id AS a, b.id AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i,
            (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS t FROM boxes a JOIN boxes b ON a.record = b.record AND a.id < b.id)
            SELECT record, a, b, ((2 * i * 1000000 + t - i) // (2 * (t - i))) / 1000000.0::DOUBLE AS iou FROM p WHERE (2 * i * 1000000 + t - i) // (2 * (t - i)) > 0""",
        "box_overlap": """WITH RECURSIVE
            o AS (SELECT l_orderkey AS record, l_linenumber AS id, l_returnflag AS label, l_discount AS confidence, x0, y0, x0 + 20 + l_partkey % 40 AS x1, y0 + 20 + l_suppkey % 40 AS y1,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_returnflag, x0, y0, l_partkey % 40, l_suppkey % 40) AS k FROM (SELECT *, l_linenumber * 10 AS x0, CAST(floor(l_quantity) AS INT) AS y0 FROM lineitem)),
            s AS (SELECT record, 0::BIGINT AS k, []::BIGINT[] AS kept FROM o GROUP BY record
              UNION ALL
              SELECT s.record, o.k, CASE WHEN EXISTS (SELECT 1 FROM o e WHERE e.record = o.record AND list_contains(s.kept, e.k) AND e.label = o.label
                AND greatest(least(o.x1, e.x1) - greatest(o.x0, e.x0), 0) * greatest(least(o.y1, e.y1) - greatest(o.y0, e.y0), 0) * 1.45 >= 0.45 * ((o.x1 - o.x0) * (o.y1 - o.y0) + (e.x1 - e.x0) * (e.y1 - e.y0))) THEN s.kept ELSE list_append(s.kept, o.k) END
              FROM s JOIN o ON o.record = s.record AND o.k = s.k + 1),
            l AS (SELECT record, arg_max(kept, k) AS kept FROM s GROUP BY record)
            SELECT o.record, o.id, o.label, o.confidence FROM o JOIN l ON o.record = l.record AND list_contains(l.kept, o.k)""",
        "graph_edges": """WITH n AS (SELECT 'customer_' || substr(md5('Customer:' || c_custkey), 1, 12) AS source, 'nation_' || substr(md5('Nation:' || lower(n_name)), 1, 12) AS nation, 'segment_' || substr(md5('Segment:' || lower(c_mktsegment)), 1, 12) AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey)
            SELECT source, 'IN_NATION' AS relation, nation AS target FROM n UNION SELECT source, 'IN_SEGMENT', segment FROM n""",
        "usage_by_status": "WITH e AS (SELECT event_type, value, TRY_CAST(props ->> '$.k' AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS calls, CAST(sum(k) AS BIGINT) AS units, count(*) FILTER (WHERE k > 50) AS heavy, round(avg(value), 6) AS mean_value FROM e GROUP BY 1",
        "paired_deltas": _EVAL_SQL + "x AS (SELECT 1) SELECT lang, " + ", ".join(f"round(avg({c}) FILTER (WHERE method = 'model') - avg({c}) FILTER (WHERE method = 'rule'), 6) AS {c}_delta" for c in ("coverage", "exact_match", "token_f1", "evidence")) + " FROM detail GROUP BY lang",
        "normalize_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS event_date FROM orders",
        "json_repair": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN TRY_CAST(props ->> '$.k' AS BIGINT) END AS k FROM events",
        "stratified_sample": """WITH c AS (SELECT source, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM documents GROUP BY source),
            s AS (SELECT *, 100 * n // total AS base, row_number() OVER (ORDER BY 100 * n % total DESC, source NULLS FIRST) AS r FROM c),
            a AS (SELECT source, least(n, base + CASE WHEN r <= 100 - (SELECT sum(base) FROM s) THEN 1 ELSE 0 END) AS take FROM s),
            d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id || '|42'), doc_id) AS rank FROM documents)
            SELECT d.doc_id, d.source FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source WHERE rank <= take""",
        "tertiles": """WITH e AS (SELECT quantile_cont(coalesce(n_chars, 0)::DOUBLE, [0.3333333333333333, 0.6666666666666666, 0.5]) AS q, count(DISTINCT coalesce(n_chars, 0)) AS many FROM documents)
            SELECT doc_id, CASE WHEN many < 3 THEN CASE WHEN coalesce(n_chars, 0) >= q[3] THEN 'high' ELSE 'low' END WHEN coalesce(n_chars, 0) <= q[1] THEN 'low' WHEN coalesce(n_chars, 0) <= q[2] THEN 'medium' ELSE 'high' END AS tertile FROM documents, e""",
        "tfidf_topk": f"""WITH q AS (SELECT query, term, count(*) AS n FROM (SELECT doc_id AS query, {tokens} AS term FROM documents) GROUP BY 1, 2),
            d AS (SELECT doc, term, count(*) AS n FROM (SELECT item_id AS doc, {tokens} AS term FROM benchmark) GROUP BY 1, 2),
            f AS (SELECT term, count(*) AS df FROM d GROUP BY 1), c AS (SELECT count(*) + 1 AS m FROM benchmark),
            dw AS (SELECT doc, term, n * (ln((1.0 + m) / (1.0 + df)) + 1) AS plain, n * (ln((1.0 + m) / (2.0 + df)) + 1) AS asked FROM d JOIN f USING (term), c),
            qw AS (SELECT query, term, n * (ln((1.0 + m) / (2.0 + coalesce(df, 0))) + 1) AS w FROM q LEFT JOIN f USING (term), c),
            qn AS (SELECT query, sum(w * w) AS s FROM qw GROUP BY 1), dn AS (SELECT doc, sum(plain * plain) AS s FROM dw GROUP BY 1),
            p AS (SELECT query, doc, sum(w * asked) AS dot, sum(asked * asked - plain * plain) AS shift FROM qw JOIN dw USING (term) GROUP BY 1, 2),
            r AS (SELECT query, doc, round(dot / sqrt(qn.s * (dn.s + shift)), 6) AS score FROM p JOIN qn USING (query) JOIN dn USING (doc)),
            a AS (SELECT doc_id AS query, item_id AS doc, coalesce(score, 0) AS score FROM documents CROSS JOIN benchmark LEFT JOIN r ON r.query = doc_id AND r.doc = item_id)
            SELECT query, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM a) WHERE rank <= 3""",
        "ranked_candidates": """WITH r AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 'E-' ELSE 'e ' END || l_suppkey % 3 AS reading FROM lineitem),
            k AS (SELECT l_orderkey, upper(regexp_replace(reading, '[^A-Za-z0-9]+', '', 'g')) AS key, count(*) AS votes, count(DISTINCT l_returnflag) AS sources, first(reading ORDER BY length(reading), l_linenumber) AS value FROM r GROUP BY 1, 2)
            SELECT *, votes * 10 + sources AS score, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY votes * 10 + sources DESC, key) AS INT) AS rank FROM k WHERE key <> ''""",
        "hourly_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    } | records.oracle_sql() | field_queries.register.sql | evaluation_queries.register.sql | relation_queries.register.sql | reconcile_queries.register.sql | crop_queries.register.sql | authority_queries.register.sql | comparison_queries.register.sql | file_queries.register.sql


def queries() -> dict:
    named = [eval_summary, eval_stratified, eval_gates, normalize_text, normalize_ids, type_status, rule_extract, ordered_text_agg, consensus, topk_regions, split_summary, leakage_check, lexical_topk, box_overlap, box_iou, graph_edges, usage_by_status, hourly_counts, paired_deltas, normalize_dates, json_repair, stratified_sample, tertiles, tfidf_topk, ranked_candidates]
    return {f.__name__: f for f in named} | records.queries() | field_queries.register.queries | evaluation_queries.register.queries | relation_queries.register.queries | reconcile_queries.register.queries | crop_queries.register.queries | authority_queries.register.queries | comparison_queries.register.queries | file_queries.register.queries
