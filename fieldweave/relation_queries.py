"""Registered queries on sets, joins, records and their summaries, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fields as R
from .functions import text as T
from .operators import records, sets, splits
from .registry import Register
from .sources.files import table

register = Register()


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


@register.add("""WITH f AS (SELECT c_custkey AS key, 0 AS frame, c_mktsegment AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 1, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, 2, o_orderpriority FROM orders)
    SELECT key, arg_min(frame, (frame, name)) AS frame, arg_min(name, (frame, name)) AS name FROM f GROUP BY key""")
def keep_first_union(spark: SparkSession, sf: str) -> DataFrame:
    """Union by key that keeps the first frame's row."""
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    first = customers.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("name"))
    second = customers.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return sets.keep_first([first, second, orders.select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name"))], "key")


@register.add("""WITH f AS (SELECT l_orderkey, l_linenumber AS k, min(l_returnflag) AS flag FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2)
    SELECT l_orderkey FROM f GROUP BY 1 HAVING count(DISTINCT k) = 3 AND min(flag) = max(flag)""")
def paired_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that all pipelines have, with equal content."""
    of = lambda k: _lines(spark, sf).filter(F.col("l_linenumber") == k).groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"))
    return sets.in_all([of(1), of(2), of(3)], "l_orderkey", "flag")


@register.add("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)""")
def remainder(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that another set doesn't have."""
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return sets.difference(table(spark, sf, "customer").select("c_custkey"), done, "c_custkey")


@register.add("""WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), o AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderkey % 10 > 0),
    b AS (SELECT l.k AS a, o.k AS b FROM l FULL JOIN o ON l.k = o.k) SELECT count(*) FILTER (WHERE b IS NULL) AS only_left, count(*) FILTER (WHERE a IS NULL) AS only_right, count(*) FILTER (WHERE a = b) AS n_both, count(*) FILTER (WHERE a IS NULL OR b IS NULL) = 0 AS equal FROM b""")
def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two sets of ids are equal."""
    orders = table(spark, sf, "orders").filter("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return sets.same_keys(_lines(spark, sf), orders, "l_orderkey")


@register.add("""WITH c AS (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier WHERE s_nationkey < 12 GROUP BY 1)
    SELECT n_nationkey, coalesce(c.n, 0) AS n_left, coalesce(s.n, 0) AS n_right FROM c FULL JOIN s USING (n_nationkey)""")
def outer_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by key of two frames, 0 where one has none."""
    customers = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return sets.outer_counts(customers, table(spark, sf, "supplier").filter("s_nationkey < 12").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey")


@register.add("""WITH h AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'x' ELSE sha256(coalesce(text, '')) END AS stored, sha256(coalesce(text, '')) AS actual FROM labels JOIN documents USING (doc_id)),
    j AS (SELECT d.doc_id, CASE WHEN actual IS NULL THEN 'missing_from_manifest' WHEN stored <> actual THEN 'sha256_mismatch' ELSE '' END AS excluded_reason FROM documents d LEFT JOIN h USING (doc_id))
    SELECT *, excluded_reason = '' AS paired_eligible FROM j""")
def shared_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Asked ids against a manifest with digests."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("actual_sha"))
    held = table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "x").otherwise(F.col("actual_sha")).alias("stored_sha"), "actual_sha")
    return records.manifest(docs, held, "doc_id")


@register.add("""WITH d AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2)
    SELECT c_custkey, c_mktsegment, event_type, value FROM customer LEFT JOIN d ON c_custkey = user_id""")
def with_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Details with the last diagnostics of their key, kept where there are none."""
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "c_mktsegment", "event_type", "value")


@register.add("""SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INT) AS place FROM conversations""")
def running_index(spark: SparkSession, sf: str) -> DataFrame:
    """Number of each row within its record."""
    return records.running_index(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", F.col("index").alias("place"))


_BOX = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_partkey % 50 AS y, l_suppkey % 50 AS x, l_partkey * 1000000000 + l_suppkey * 10000 + l_linenumber * 100 + l_quantity::INT AS id FROM lineitem"


@register.add(f"""WITH b AS ({_BOX}), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, id) AS k FROM b)
    SELECT l_orderkey, id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY y, x, id) AS INT) AS place FROM k WHERE k <= 4""")
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """The surest regions in reading order."""
    rows = _lines(spark, sf).selectExpr("l_orderkey", "l_discount", "l_partkey % 50 AS y", "l_suppkey % 50 AS x", "l_partkey * 1000000000 + l_suppkey * 10000 + l_linenumber * 100 + cast(round(l_quantity) as int) AS id")
    return records.reading_order(rows, "l_orderkey", 4, "l_discount", "y", "x", "id").select("l_orderkey", "id", "place")


@register.add("""WITH c AS (SELECT DISTINCT conv_id, turn, role FROM conversations), t AS (SELECT conv_id, turn, role, string_agg(text, chr(10) ORDER BY text) AS texts FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' AND turn % 5 > 0 GROUP BY 1, 2, 3)
    SELECT conv_id, string_agg('[' || c.role || ']' || chr(10) || coalesce(texts, ''), chr(10) || chr(10) ORDER BY turn, c.role) AS prompt, count(*) FILTER (WHERE texts IS NULL) AS n_empty FROM c LEFT JOIN t USING (conv_id, turn, role) GROUP BY 1""")
def evidence_packets(spark: SparkSession, sf: str) -> DataFrame:
    """Components with their readings, nested and as prompt text."""
    rows = table(spark, sf, "conversations")
    region = F.struct("turn", "role").alias("region")
    readings = rows.filter("turn % 5 > 0").select("conv_id", region, "text", F.lit(0).alias("pos"))
    made = records.packets(rows.select("conv_id", region, F.col("role").alias("kind")).distinct(), readings, "conv_id", "region", "pos")
    return made.select("conv_id", records.packet_text(F.col("packet")).alias("prompt"), F.col("empty").alias("n_empty"))


_CANDS = """r AS (SELECT l_orderkey, l_returnflag AS source, 'E' || CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE ' ' END || lpad(CAST(l_orderkey AS VARCHAR), 6, '0') || CASE WHEN l_suppkey % 3 = 0 THEN '9' ELSE '' END AS value FROM lineitem),
    k AS (SELECT l_orderkey, upper(regexp_replace(value, '[^A-Za-z0-9]+', '', 'g')) AS key, count(*) AS votes, string_agg(DISTINCT source, ';' ORDER BY source) AS sources, arg_min(value, (length(value), value)) AS value FROM r GROUP BY 1, 2),
    s AS (SELECT *, votes * 10 + 2 + CASE WHEN length(key) BETWEEN 7 AND 16 THEN 1 ELSE 0 END + 1 AS score FROM k)"""


def _read(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("l_linenumber") % 2 == 0, "-").otherwise(" ")
    value = F.concat(F.lit("E"), mark, F.lpad(F.col("l_orderkey").cast("string"), 6, "0"), F.when(F.col("l_suppkey") % 3 == 0, "9").otherwise(""))
    return _lines(spark, sf).select("l_orderkey", F.col("l_returnflag").alias("source"), value.alias("text"))


@register.add(f"WITH {_CANDS} SELECT l_orderkey, key, votes, sources, value, score, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, votes DESC, key) AS INT) AS rank FROM s")
def catalog_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked identifiers of a record, by votes and shape."""
    return records.candidates(_read(spark, sf), "l_orderkey", "text", "source")


@register.add(f"""WITH {_CANDS}, p AS (SELECT *, 1 AS priority FROM s UNION ALL SELECT o_orderkey, 'E' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), 1, 'barcode', 'e' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0'), 100, 2 FROM orders WHERE o_orderkey % 4 = 0),
    u AS (SELECT l_orderkey, key, unnest(string_split(sources, ';')) AS source FROM p), g AS (SELECT l_orderkey, key, string_agg(DISTINCT source, ';' ORDER BY source) AS sources FROM u GROUP BY 1, 2)
    SELECT l_orderkey, key, max(votes) AS votes, max(score) AS score, any_value(g.sources) AS sources, arg_min(value, (-priority, value)) AS value FROM p JOIN g USING (l_orderkey, key) GROUP BY 1, 2""")
def identifier_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of readings and barcodes, merged by priority."""
    read = records.candidates(_read(spark, sf), "l_orderkey", "text", "source", 1000).withColumn("priority", F.lit(1))
    number = F.lpad(F.col("o_orderkey").cast("string"), 6, "0")
    codes = table(spark, sf, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("E"), number).alias("key"), F.lit(1).cast("long").alias("votes"), F.lit("barcode").alias("sources"), F.concat(F.lit("e"), number).alias("value"), F.lit(100).cast("long").alias("score"), F.lit(2).alias("priority"))
    return records.merged_candidates(read.drop("rank").unionByName(codes), "l_orderkey")


@register.add("""WITH v AS (SELECT o_orderkey, 'E' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS key FROM orders),
    t AS (SELECT l_orderkey AS o_orderkey, upper(regexp_replace('seen E ' || lpad(CAST(l_orderkey + CAST(l_suppkey % 5 = 0 AS INT) AS VARCHAR), 6, '0') || ' here', '[^A-Za-z0-9]+', '', 'g')) AS body FROM lineitem)
    SELECT o_orderkey, key, max(contains(body, key)) AS supported FROM v JOIN t USING (o_orderkey) GROUP BY 1, 2""")
def contained_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that stand in a text of their record."""
    values = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("e-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("value"))
    texts = _lines(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("seen E "), F.lpad((F.col("l_orderkey") + (F.col("l_suppkey") % 5 == 0).cast("int")).cast("string"), 6, "0"), F.lit(" here")).alias("text"))
    return records.contained(values, texts, "o_orderkey", "value", "text")


_STABLE = """r AS (SELECT user_id, event_id, ['catalogNumber', 'country', 'typeStatus'][event_id % 3 + 1] AS field, CASE WHEN user_id % 5 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'other' ELSE 'same' END AS value, CAST(user_id % 4 < 3 AS INT) AS direct, CAST(event_id % 11 = 0 AS INT) AS review, CASE WHEN event_id % 13 > 0 THEN 0.7 + event_id % 3 / 10.0 END AS c FROM events),
    v AS (SELECT user_id, field, value, count(*) AS c, min(event_id) AS f, sum(direct) AS d, sum(review) AS w, min(c) AS s, count(c) AS known FROM r GROUP BY 1, 2, 3),
    g AS (SELECT user_id, field, arg_max(value, (c, -f)) AS consensus, arg_max(c, (c, -f)) AS top, sum(c) AS n, sum(c * (c - 1)) AS pairs, sum(d) AS d, sum(w) AS w, min(s) AS s, sum(known) AS known FROM v GROUP BY 1, 2),
    stable AS (SELECT user_id, field, consensus, round(CASE WHEN n > 1 THEN pairs / (n * (n - 1)) ELSE 1.0 END, 6)::DOUBLE AS agreement,
      CASE WHEN consensus <> '' AND top = n AND d = n AND w = 0 AND known = n AND s >= 0.75 THEN 'auto_accept' WHEN consensus = '' AND top = n THEN 'empty_consensus' ELSE 'human_review' END AS action, top = 1 OR d = 0 OR field = 'catalogNumber' AS urgent FROM g)"""


def _stable(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    field = F.element_at(F.array(*map(F.lit, ["catalogNumber", "country", "typeStatus"])), (e % 3 + 1).cast("int"))
    value = F.when(F.col("user_id") % 5 == 0, "").when(e % 7 == 0, "other").otherwise("same")
    rows = table(spark, sf, "events").select("user_id", "event_id", field.alias("field"), value.alias("value"), (F.col("user_id") % 4 < 3).cast("int").alias("direct"), (e % 11 == 0).cast("int").alias("review"), F.when(e % 13 > 0, 0.7 + e % 3 / 10.0).alias("confidence"))
    return records.stability(rows, "user_id", "field", "value", "event_id")


@register.add(f"WITH {_STABLE} SELECT user_id, field, consensus, agreement, action, CASE WHEN action <> 'human_review' THEN '' WHEN urgent THEN 'high' ELSE 'medium' END AS priority FROM stable")
def repeat_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Consensus over repeats with action and priority."""
    return _stable(spark, sf)


@register.add(f"WITH {_STABLE} SELECT field, count(*) AS n, round(avg(agreement), 6) AS agreement, round(avg(CAST(action = 'auto_accept' AS INT)), 6) AS auto_accept, round(avg(CAST(action = 'human_review' AS INT)), 6) AS human_review FROM stable GROUP BY 1")
def field_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of agreement and of actions by field."""
    rate = lambda a: F.round(F.avg((F.col("action") == a).cast("int")), 6).alias(a)
    return _stable(spark, sf).groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("agreement"), 6).alias("agreement"), rate("auto_accept"), rate("human_review"))


@register.add("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS records, round(avg(CAST(l_discount > 0 AS INT)), 6) AS nonempty_rate, round(sum(l_quantity) / count(DISTINCT l_orderkey), 6) AS mean_of_sums, round(max(l_tax), 6) AS most FROM lineitem GROUP BY 1""")
def channel_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, distinct records, rates and means of sums by channel."""
    per = _lines(spark, sf).groupBy("l_returnflag", "l_orderkey").agg(F.count("*").alias("n"), F.sum((F.col("l_discount") > 0).cast("int")).alias("filled"), F.sum("l_quantity").alias("q"), F.max("l_tax").alias("most"))
    return per.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.count("*").alias("records"), F.round(F.sum("filled") / F.sum("n"), 6).alias("nonempty_rate"), F.round(F.sum("q") / F.count("*"), 6).alias("mean_of_sums"), F.round(F.max("most"), 6).alias("most"))


@register.add("""SELECT conv_id, coalesce(string_agg(DISTINCT text, ' | ' ORDER BY text) FILTER (WHERE role = 'user'), '') AS asked, coalesce(string_agg(DISTINCT text, ' | ' ORDER BY text) FILTER (WHERE role = 'assistant'), '') AS answered FROM conversations GROUP BY 1""")
def engine_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Different texts by engine, one column an engine."""
    joined = lambda r, name: F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == r, F.col("text")))), " | ").alias(name)
    return table(spark, sf, "conversations").groupBy("conv_id").agg(joined("user", "asked"), joined("assistant", "answered"))


@register.add("""WITH n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS genus FROM part), a AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS genus FROM part WHERE p_size < 3)
    SELECT count(*) AS total, count(a.genus) AS known, round(count(a.genus) / count(*), 6) AS coverage FROM n LEFT JOIN a USING (genus)""")
def genus_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of different first words that an authority knows."""
    genus = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("genus"), "p_size")
    known = genus.groupBy("genus").agg(F.max((F.col("p_size") < 3).cast("int")).alias("known"))
    return known.agg(F.count("*").alias("total"), F.sum("known").alias("known"), F.round(F.sum("known") / F.count("*"), 6).alias("coverage"))


@register.add("""WITH m AS (SELECT l_linestatus, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax FROM lineitem GROUP BY 1)
    SELECT l_linestatus, discount, tax, round(discount - 0.05, 6)::DOUBLE AS discount_delta, round(tax - 0.04, 6)::DOUBLE AS tax_delta FROM m""")
def frozen_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Means less frozen reference figures."""
    mean = lambda c: F.round(F.avg(c), 6)
    rows = _lines(spark, sf).groupBy("l_linestatus").agg(mean("l_discount").alias("discount"), mean("l_tax").alias("tax"))
    return rows.select("*", F.round(F.col("discount") - 0.05, 6).alias("discount_delta"), F.round(F.col("tax") - 0.04, 6).alias("tax_delta"))


@register.add("""WITH m AS (SELECT l_orderkey, avg(l_discount) FILTER (WHERE l_linestatus = 'O') AS a, avg(l_discount) FILTER (WHERE l_linestatus = 'F') AS b FROM lineitem GROUP BY 1),
    d AS (SELECT l_orderkey, CASE WHEN round(b - a, 6) = 0 THEN 0.0 ELSE round(b - a, 6) END AS delta FROM m WHERE a IS NOT NULL AND b IS NOT NULL), v AS (SELECT *, CASE WHEN delta > 0 THEN 'helped' WHEN delta < 0 THEN 'hurt' ELSE 'same' END AS verdict FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY abs(delta) DESC, l_orderkey) AS k FROM v) SELECT l_orderkey, delta, verdict FROM r WHERE k <= 10""")
def helped_and_hurt(spark: SparkSession, sf: str) -> DataFrame:
    """The ten records that gained, lost and kept most between two methods."""
    mean = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_discount")))
    deltas = _lines(spark, sf).groupBy("l_orderkey").agg(F.round(mean("F") - mean("O"), 6).alias("delta")).filter("delta is not null")
    deltas = deltas.withColumn("delta", F.when(F.col("delta") == 0, 0.0).otherwise(F.col("delta")))  # no negative zero
    told = deltas.withColumn("verdict", records.verdicts(deltas, "delta"))
    most = F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("delta")).alias("_order"), "l_orderkey", "delta"))), 1, 10)
    # Each task keeps ten of a verdict before they meet.
    near = told.withColumn("part", F.spark_partition_id()).groupBy("verdict", "part").agg(most.alias("top")).select("verdict", F.inline("top"))
    return near.groupBy("verdict").agg(most.alias("top")).select("verdict", F.inline("top")).select("l_orderkey", "delta", "verdict")


@register.add("""WITH m AS (SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS best FROM events GROUP BY 1)
    SELECT user_id, event_id, event_type FROM events JOIN m USING (user_id) WHERE best > 0 AND best = CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END""")
def method_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the best method that a record has, by a chain of preferences."""
    order = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type").startswith("cl"), 2).when(F.col("event_type") == "view", 1).otherwise(0)
    rows = table(spark, sf, "events").withColumn("order", order)
    best = rows.groupBy("user_id").agg(F.max("order").alias("best")).filter("best > 0")
    return rows.join(best, "user_id").filter("order = best").select("user_id", "event_id", "event_type")


@register.add("""WITH i AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer)
    SELECT 'customer_' || substr(md5('Customer:' || lower(c_name)), 1, 12) AS node_id, 'Customer' AS node_type, min(c_name) AS label FROM i GROUP BY 1
    UNION ALL SELECT 'segment_' || substr(md5('Segment:' || lower(c_mktsegment)), 1, 12), 'Segment', min(c_mktsegment) FROM i GROUP BY 1""")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of a graph, one an id, with the least label."""
    rows = table(spark, sf, "customer")
    of = lambda kind, c: rows.filter(T.clean(F.col(c)) != "").groupBy(R.node_id(kind, F.col(c)).alias("node_id")).agg(F.lit(kind).alias("node_type"), F.min(T.clean(F.col(c))).alias("label"))
    return of("Customer", "c_name").unionByName(of("Segment", "c_mktsegment"))


@register.add("""WITH b AS (SELECT l_orderkey, l_linenumber AS id, l_partkey, l_suppkey, l_quantity, l_linenumber * 10 AS x0, l_quantity::INT AS y0, l_linenumber * 10 + 20 + l_partkey % 40 AS x1, l_quantity::INT + 20 + l_suppkey % 40 AS y1 FROM lineitem),
    p AS (SELECT a.l_orderkey, a.id AS a, b.id AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS s FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.id < b.id)
    SELECT l_orderkey, a, b, ((2 * i * 1000000 + s) // (2 * s)) / 1000000.0::DOUBLE AS contained FROM p WHERE i > 0""")
def box_containment(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the smaller of two boxes of a record that lies in the other."""
    from .operators import geometry

    x0, y0 = F.col("l_linenumber") * 10, F.round("l_quantity").cast("int")
    boxes = _lines(spark, sf).select("l_orderkey", F.col("l_linenumber").alias("id"), F.struct(x0.cast("long").alias("x0"), y0.cast("long").alias("y0"), (x0 + 20 + F.col("l_partkey") % 40).alias("x1"), (y0 + 20 + F.col("l_suppkey") % 40).alias("y1")).alias("box"))
    pairs = boxes.alias("a").join(boxes.alias("b"), "l_orderkey").filter("a.id < b.id").filter(geometry.touching(F.col("a.box"), F.col("b.box")))
    i, s = geometry.intersection(F.col("a.box"), F.col("b.box")), F.least(geometry.area(F.col("a.box")), geometry.area(F.col("b.box")))
    return pairs.filter(i > 0).select("l_orderkey", F.col("a.id").alias("a"), F.col("b.id").alias("b"), (F.floor((2 * i * 1_000_000 + s) / (2 * s)) / 1e6).alias("contained"))


@register.add("""WITH c AS (SELECT source, count(*) AS rows, 200.0 * count(*) / sum(count(*)) OVER () AS raw FROM documents GROUP BY 1),
    a AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base, greatest(CAST(floor(raw) AS BIGINT), 1) AS take FROM c),
    r AS (SELECT *, row_number() OVER (ORDER BY raw - floor(raw) DESC, source NULLS FIRST) AS up, sum(take) OVER () AS given FROM a)
    SELECT source, least(rows, take + CASE WHEN given < 200 AND up <= 200 - given THEN 1 ELSE 0 END) AS take FROM r""")
def allocation(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of each stratum a sample takes, at least one."""
    return splits.allocation_of_one(table(spark, sf, "documents"), "source", 200)


@register.add("""WITH s AS (SELECT c_custkey, c_mktsegment, sha256(c_mktsegment || '|42') AS h FROM customer), d AS (SELECT c_mktsegment FROM s GROUP BY 1 ORDER BY min(h) LIMIT 1),
    m AS (SELECT *, c_mktsegment IN (SELECT c_mktsegment FROM d) AS demo, row_number() OVER (PARTITION BY c_mktsegment IN (SELECT c_mktsegment FROM d) ORDER BY sha256(c_custkey || '|42'), c_custkey) AS k FROM s)
    SELECT c_custkey, c_mktsegment, CASE WHEN demo THEN 'demo' ELSE 'eval' END AS split FROM m WHERE k <= CASE WHEN demo THEN 5 ELSE 50 END""")
def disjoint_split(spark: SparkSession, sf: str) -> DataFrame:
    """Demonstration and evaluation rows from different groups, of stated sizes."""
    return splits.disjoint(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 5, 50, 42)


@register.add("""WITH q AS (SELECT vec_id AS query, embedding FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.query, e.vec_id AS doc, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 5) AS score FROM q, embeddings e WHERE e.vec_id <> q.query)
    SELECT query, doc, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM p) WHERE rank <= 3""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest vectors by inner product, for a stated set of queries against all rows."""
    from .operators import retrieval

    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.dense(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "embedding", 3)
