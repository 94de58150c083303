"""Registered queries on review, resolution and summaries of records, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import resolve, review, summaries
from .operators.evidence import ranked_candidates
from .sources.files import table


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    score = lambda c, k: F.when(F.col(c) % 7 != 0, (F.col(c) % k) / float(k - 1))
    field = F.element_at(F.array(*map(F.lit, ["country", "eventDate", "catalogNumber", "locality"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    status = review.support_status(F.col("l_quantity") > 5, score("l_partkey", 3), score("l_suppkey", 5), score("l_orderkey", 2))
    rows = rows.select("l_orderkey", "l_linenumber", field.alias("field"), status.alias("status"), score("l_partkey", 11).alias("confidence"), (F.col("l_returnflag") == "R").alias("warning"))
    decision = review.decide(F.col("field"), F.col("status"), F.col("confidence"), F.col("warning"))
    return rows.select("l_orderkey", "l_linenumber", "field", "status", decision.alias("d")).filter("d.review").select("l_orderkey", "l_linenumber", "field", "status", "d.priority", "d.reasons")


def canonical_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    land = F.element_at(F.array(*map(F.lit, [" UK", "usa", "England ", "Peru", "u.s.a."])), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.lit("  "), F.upper(F.substr("p_name", F.lit(1), F.lit(1))), F.substr("p_name", F.lit(2)), F.lit("   (L.) 1753"))
    return rows.select("p_partkey", resolve.country(land).alias("country"), resolve.binomial(name).alias("name"))


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    own = F.concat(F.lit("E"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0"), F.lit("-"), (F.col("l_suppkey") % 3).cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", own.alias("reading"))


def safe_extension(spark: SparkSession, sf: str) -> DataFrame:
    own = F.when(F.col("o_orderkey") % 10 == 0, "").when(F.col("o_orderkey") % 10 == 1, "no number").otherwise(F.concat(F.lit("e "), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), own.alias("own_value"))
    return resolve.safe_extension(orders, _readings(spark, sf), "l_orderkey", "own_value", "reading", "l_linenumber")


def resolve_identifier(spark: SparkSession, sf: str) -> DataFrame:
    ranked = ranked_candidates(_readings(spark, sf), "l_orderkey", T.identifier_key(F.col("reading")), "reading", "l_returnflag", "l_linenumber")
    return resolve.best_candidate(ranked, "l_orderkey")


def diverse_regions(spark: SparkSession, sf: str) -> DataFrame:
    best = resolve.diverse(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", F.col("l_extendedprice"), "l_linenumber", {"R": 1, "A": 2, "N": 2}, 4)
    return best.select("l_orderkey", "l_linenumber", "l_returnflag", "place")


def macro_micro(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.macro_micro(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", F.col("l_discount"))


def field_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.pivot_means(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.col("l_quantity"))


def dense_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return summaries.dense_counts(table(spark, sf, "customer"), orders, "c_custkey", F.col("price"))


def in_all_types(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.in_all(table(spark, sf, "events"), "user_id", "event_type", ["view", "click", "purchase", "signup"])


def last_event(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.last_of(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id", "value")


def distinct_lines(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.distinct_lines(table(spark, sf, "conversations"), "conv_id", "turn", "text")


def mean_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.mean_vectors(table(spark, sf, "embeddings"), "label", "embedding")


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.bootstrap(table(spark, sf, "lineitem"), "l_returnflag", "l_orderkey", "l_quantity")


_SCORE = "CASE WHEN {c} % 7 <> 0 THEN ({c} % {k}) / {d}.0 END"
_READ = "(SELECT l_orderkey, l_linenumber, l_returnflag, 'E' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || '-' || l_suppkey % 3 AS reading FROM lineitem)"
_KEY = "upper(regexp_replace({c}, '[^A-Za-z0-9]+', '', 'g'))"


def _score(c: str, k: int) -> str:
    return f"CAST({_SCORE.format(c=c, k=k, d=k - 1)} AS DOUBLE)"


def oracle_sql() -> dict[str, str]:
    times = " + ".join(f"CASE WHEN u >= {x:.8f}::DOUBLE THEN 1 ELSE 0 END" for x in summaries.DRAWS)
    return {
        "review_queue": f"""WITH s AS (SELECT l_orderkey, l_linenumber, ['country', 'eventDate', 'catalogNumber', 'locality'][l_linenumber % 4 + 1] AS field, l_linenumber % 4 < 2 AS risky,
              l_quantity > 5 AS predicted, {_score("l_partkey", 3)} AS e, {_score("l_suppkey", 5)} AS a, {_score("l_orderkey", 2)} AS r, {_score("l_partkey", 11)} AS c, l_returnflag = 'R' AS w FROM lineitem),
            t AS (SELECT *, CASE WHEN NOT predicted THEN 'not_predicted' WHEN e >= 1 AND a >= 0.5 THEN 'direct' WHEN e >= 0.5 AND a >= 0.5 THEN 'partial_direct'
              WHEN r >= 1 THEN 'prediction_in_ocr' WHEN e >= 1 THEN 'contextual_inference' ELSE 'unsupported' END AS status FROM s),
            q AS (SELECT *, concat_ws(';', CASE WHEN status <> 'direct' THEN 'support:' || status END, CASE WHEN c IS NULL THEN 'confidence:missing' WHEN c < 0.75 THEN 'confidence_below:0.75' END,
              CASE WHEN risky AND status <> 'direct' THEN 'high_risk_without_direct_evidence' END, CASE WHEN risky AND (c IS NULL OR c < 0.9) THEN 'high_risk_confidence_below:0.9' END,
              CASE WHEN w THEN 'schema_validation_warning' END) AS reasons FROM t WHERE predicted)
            SELECT l_orderkey, l_linenumber, field, status, reasons,
              CASE WHEN status = 'unsupported' OR (risky AND status <> 'direct') OR coalesce(c < 0.5, false) THEN 'high' ELSE 'medium' END AS priority FROM q WHERE reasons <> ''""",
        "canonical_values": """SELECT p_partkey, ['United Kingdom', 'United States', 'United Kingdom', 'Peru', 'United States'][p_partkey % 5 + 1] AS country,
            coalesce(nullif(regexp_extract(upper(p_name[1:1]) || p_name[2:], '^[A-Z][a-zA-Z-]+ [a-z][a-zA-Z-]+'), ''), upper(p_name[1:1]) || p_name[2:] || ' (L.) 1753') AS name FROM part""",
        "safe_extension": f"""WITH o AS (SELECT o_orderkey AS l_orderkey, CASE o_orderkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'no number' ELSE 'e ' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS original FROM orders),
            k AS (SELECT l_orderkey, {_KEY.format(c="reading")} AS key, arg_min(reading, l_linenumber) AS reading FROM {_READ} GROUP BY 1, 2),
            f AS (SELECT o.l_orderkey, original, {_KEY.format(c="original")} AS own, k.reading, k.key,
              length(k.key) - length(own) BETWEEN 1 AND 4 AND starts_with(k.key, own) AND regexp_full_match(own, '[A-Z]{{1,4}}[0-9]{{4,14}}') AND regexp_full_match(k.key, '[A-Z]{{1,4}}[0-9]{{6,14}}') AS fits
              FROM o LEFT JOIN k USING (l_orderkey)),
            g AS (SELECT l_orderkey, original, own, count(*) FILTER (WHERE fits) AS n, any_value(reading) FILTER (WHERE fits) AS only_one FROM f GROUP BY 1, 2, 3)
            SELECT l_orderkey, CASE WHEN n = 1 THEN only_one ELSE original END AS value, CASE WHEN own = '' THEN 'not_provided' WHEN NOT regexp_full_match(own, '[A-Z]{{1,4}}[0-9]{{4,14}}') THEN 'original_not_structured'
              WHEN n = 1 THEN 'strict_extension_applied' WHEN n > 1 THEN 'ambiguous_extension' ELSE 'no_safe_extension' END AS status FROM g""",
        "resolve_identifier": f"""WITH k AS (SELECT l_orderkey, {_KEY.format(c="reading")} AS key, count(*) * 10 + count(DISTINCT l_returnflag) AS score, any_value(reading) AS value FROM {_READ} GROUP BY 1, 2),
            r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, key) AS rank, max(score) OVER (PARTITION BY l_orderkey) AS top FROM k)
            SELECT l_orderkey, min(value) FILTER (WHERE rank = 1) AS value, coalesce(string_agg(value, ';' ORDER BY rank) FILTER (WHERE rank > 1 AND score >= greatest(25, top - 35)), '') AS alternatives,
              count(*) FILTER (WHERE rank > 1 AND score >= greatest(25, top - 35)) > 0 AS review FROM r GROUP BY 1""",
        "diverse_regions": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem),
            b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN k > 1 THEN 3 ELSE instr('RAN', l_returnflag) - 1 END, l_extendedprice DESC, l_linenumber) AS place
              FROM a WHERE k <= CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END)
            SELECT l_orderkey, l_linenumber, l_returnflag, CAST(place AS INT) AS place FROM b WHERE place <= 4""",
        "macro_micro": """WITH f AS (SELECT l_returnflag, l_linestatus, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2),
            g AS (SELECT l_returnflag, round(avg(l_discount), 6) AS micro, round(avg(l_discount) FILTER (WHERE l_discount > 0), 6) AS filled FROM lineitem GROUP BY 1)
            SELECT l_returnflag, round(avg(m), 6) AS macro, any_value(micro) AS micro, any_value(filled) AS filled FROM f JOIN g USING (l_returnflag) GROUP BY 1""",
        "field_pivot": "SELECT l_returnflag, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'F'), 6) AS F, round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS O FROM lineitem GROUP BY 1",
        "dense_counts": """SELECT c_custkey, count(o_orderkey) AS n, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS total
            FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""",
        "in_all_types": "SELECT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup') GROUP BY 1 HAVING count(DISTINCT event_type) = 4",
        "last_event": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
        "distinct_lines": """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS "at" FROM conversations),
            f AS (SELECT conv_id, line, min(turn::BIGINT * 1000000000 + "at") AS "first" FROM l WHERE trim(line) <> '' GROUP BY 1, 2)
            SELECT conv_id, string_agg(line, chr(10) ORDER BY "first", line) AS lines, count(*) AS n_lines FROM f GROUP BY 1""",
        "mean_vectors": """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
            m AS (SELECT label, dim, avg(x) AS mean FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(mean * mean)) AS norm FROM m GROUP BY 1)
            SELECT label, CAST(dim AS INT) AS dim, round(CASE WHEN norm > 0 THEN mean / norm ELSE mean END, 6) AS value FROM m JOIN n USING (label)""",
        "bootstrap_ci": f"""WITH r AS (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2),
            d AS (SELECT *, CAST('0x' || substr(md5(l_orderkey || '|' || draw // 4), 8 * (draw % 4) + 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM r, range(0, 500) t(draw)),
            s AS (SELECT l_returnflag, draw, sum(m * ({times})) / sum({times}) AS x FROM d GROUP BY 1, 2),
            c AS (SELECT l_returnflag, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM s GROUP BY 1)
            SELECT l_returnflag, round(avg(m), 6) AS mean, count(*) AS n_records, any_value(low) AS low, any_value(high) AS high FROM r JOIN c USING (l_returnflag) GROUP BY 1""",
    }


def queries() -> dict:
    named = [review_queue, canonical_values, safe_extension, resolve_identifier, diverse_regions, macro_micro, field_pivot, dense_counts, in_all_types, last_event, distinct_lines, mean_vectors, bootstrap_ci]
    return {f.__name__: f for f in named}
