"""Registered queries that write tables through the sinks and read them again through the sources, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import prompts
from .registry import Register
from .sinks import files as K
from .sinks import ledger
from .sinks.places import new_path
from .sources import files as R
from .sources.files import table

register = Register()

_ODD = """CASE p_partkey % 6 WHEN 0 THEN 'a "quoted", cell' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN ' nan ' WHEN 3 THEN NULL WHEN 4 THEN '' ELSE p_name || ' é' END"""


@register.add(f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, {S.clean(_ODD)} AS note, '[' || p_size || ',' || p_size + 1 || ']' AS sizes, '' AS country FROM part")
def csv_stages(spark: SparkSession, sf: str) -> DataFrame:
    """A stage written as CSV and read as text, odd cells, lists and a missing column included."""
    rows = table(spark, sf, "part").select("p_partkey", F.expr(_ODD).alias("note"), F.array("p_size", F.col("p_size") + 1).alias("sizes"))
    path = K.stages({"parts": rows}, new_path(spark, "stages"))["parts"]
    again = R.stage_or(spark, path, lambda: rows.limit(0))
    return R.records(spark, path, ["country"], "p_partkey").join(again.select("p_partkey"), "p_partkey", "left_semi")


@register.add("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END FROM orders WHERE o_orderkey % 10 = 0")
def json_lines_twice(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines of two runs, the second appended."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price"))
    path = new_path(spark, "lines")
    K.json_lines(rows, path)
    K.json_lines(rows.filter("o_orderkey % 10 = 0"), path)
    return R.json_lines(spark, path, "o_orderkey long, o_orderstatus string, price double")


@register.add("SELECT user_id, count(*) AS n, CASE WHEN user_id % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM events GROUP BY 1, 3")
def ledger_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Results by key over two runs, the second of which leaves out what the first has done (K4, K7)."""
    events = table(spark, sf, "events")
    path = new_path(spark, "ledger")
    count = lambda run: lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("run", F.lit(run))
    ledger.resumed(spark, events.filter("user_id % 2 = 0"), path, ["user_id"], count("first"))
    return ledger.resumed(spark, events, path, ["user_id"], count("second"))


@register.add("""SELECT event_id AS eval_id, value AS eval_value, CASE WHEN event_id % 2 = 0 THEN '{"x":"' || user_id || '"}' ELSE '{}' END AS meta FROM events""")
def sanitised_events(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of some prefixes, and a JSON column without some keys (K8)."""
    meta = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.lit("s").alias("api_key"), F.col("user_id").cast("string").alias("x")))).otherwise('{"api_key": "t"}')
    rows = table(spark, sf, "events").select(F.col("event_id").alias("eval_id"), F.col("value").alias("eval_value"), F.col("ts").alias("raw_ts"), meta.alias("meta"))
    return K.sanitised(rows, ["eval_"], ["api_key"], "meta")


_URL = "CASE page_id % 5 WHEN 0 THEN url || '/a b.PNG?x=1' WHEN 1 THEN url || '/c.exe' WHEN 2 THEN url || '/d.tiff#top' WHEN 3 THEN NULL ELSE '_ ' || url || '.jpeg' END"


@register.add(f"""SELECT page_id, regexp_replace(regexp_replace({S.clean(_URL)}, '[^A-Za-z0-9\\-_.]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name,
    CASE WHEN lower(regexp_extract(coalesce({_URL}, ''), '^[^?#]*\\.([A-Za-z]+)(?:[?#].*)?$', 1)) IN ({S.listed(R.SUFFIXES)}) THEN '.' || lower(regexp_extract({_URL}, '^[^?#]*\\.([A-Za-z]+)(?:[?#].*)?$', 1)) ELSE '.jpg' END AS suffix FROM pages""")
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    """Safe file names and image suffixes of URLs."""
    url = F.expr(_URL)
    return table(spark, sf, "pages").select("page_id", R.safe_name(url).alias("name"), R.suffix_of(url).alias("suffix"))


@register.add("""WITH i AS (SELECT CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' nan' ELSE c_name END AS a, CASE WHEN c_custkey % 4 = 0 THEN 'b' || c_custkey END AS b, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name || '.jpg' END AS image, c_mktsegment FROM customer)
    SELECT CASE WHEN a NOT IN ('', ' nan') THEN a WHEN b IS NOT NULL THEN b ELSE 'image-' || substr(sha256(image), 1, 16) END AS id, image, c_mktsegment FROM i WHERE trim(image) <> ''""")
def rows_with_images(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that have an image, under the first id they have."""
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.when(key % 4 == 0, "").when(key % 4 == 1, " nan").otherwise(F.col("c_name")).alias("a"), F.when(key % 4 == 0, F.concat(F.lit("b"), key.cast("string"))).alias("b"), F.when(key % 5 == 0, " ").otherwise(F.concat("c_name", F.lit(".jpg"))).alias("image"), "c_mktsegment", "c_acctbal")
    return R.with_images(rows, "image", ["a", "b", "missing"], "id", ["image", "c_mktsegment", "absent"])


@register.add("""SELECT c_name AS name, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE 'N' || c_nationkey END AS country, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'u' || c_custkey END AS image, '' AS state FROM customer WHERE c_custkey % 7 > 0 AND c_nationkey % 3 > 0""")
def aliased_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns under their usual names; rows with enough of them and an image."""
    rows = table(spark, sf, "customer").select(F.col("c_name").alias("FullName"), F.when(F.col("c_nationkey") % 3 == 0, None).otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("land"), F.when(F.col("c_custkey") % 7 == 0, " nan ").otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).alias("JPEGurl"), "c_acctbal")
    return R.aliased(rows, {"name": ["name"], "country": ["land", "country"], "image": ["jpegurl"], "state": ["province"]}, ["name", "country"], 2, "image")


@register.add("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'lean_a_outputs.jsonl' ELSE 'lean_b_outputs.jsonl' END AS file FROM orders""")
def family_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the files of the first family that has any, with their file."""
    path = new_path(spark, "families")
    rows = table(spark, sf, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("k"))).alias("value"), "o_orderkey")
    for name, some in (("lean_a", "o_orderkey % 2 = 0"), ("lean_b", "o_orderkey % 2 = 1"), ("old_c", "o_orderkey % 5 = 0")):
        rows.filter(some).select("value").write.text(f"{path}/{name}_outputs.jsonl")
    # Spark names part files; the family is the folder's name.
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("file")).filter("file like '%_outputs.jsonl'")
    rank = F.when(F.col("file").startswith("none_"), 0).when(F.col("file").startswith("lean_"), 1).otherwise(2)
    ranked = lines.withColumn("rank", rank)
    first = ranked.agg(F.min("rank").alias("rank"))
    return ranked.join(F.broadcast(first), "rank").select(F.get_json_object("value", "$.k").cast("long").alias("k"), "file")  # one row


_HEAD, _SAID = "CASE p_partkey % 4 WHEN 0 THEN 'FIELD=x' WHEN 1 THEN '' WHEN 2 THEN 'nan' ELSE NULL END", "CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END"


@register.add(f"""WITH i AS (SELECT p_partkey, p_brand, p_type, p_size, {S.clean(_HEAD)} AS head, {_SAID} AS said FROM part)
    SELECT p_partkey, CASE WHEN head <> '' AND said <> '' THEN '[' || head || ']' || chr(10) || said WHEN said <> '' THEN '[' || p_type || ']' || chr(10) || said ELSE said END AS prompt, '[1] ' || p_brand || ': ' || p_type || chr(10) || '[2] ' || p_type || ': None' AS context,
      CASE WHEN said <> '' THEN '[region_id=' || p_brand || '; component_type=' || p_type || '; engine=a]' || chr(10) || said || chr(10) || chr(10) ELSE '' END || '[region_id=' || p_brand || '; component_type=' || p_type || '; engine=b]' || chr(10) || p_brand AS packet,
      'FIELD=catalog_number; SOURCE=tesseract_crop_ensemble; candidate_count=' || p_size % 3 || '; ambiguous=' || CASE WHEN p_size % 3 > 1 THEN 'true' ELSE 'false' END || '; ranked_hypotheses=true' AS header FROM i""")
def prompt_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Headed readings, numbered context, packets of evidence, headers of hypotheses."""
    said = F.expr(_SAID)
    item = lambda s, t: F.struct(s.alias("source"), t.alias("text"))
    reading = lambda e, t: F.struct(F.lit(e).alias("engine"), t.alias("raw_text"))
    brand, kind = F.col("p_brand"), F.col("p_type")
    component = F.struct(brand.alias("region_id"), kind.alias("component_type"), F.array(reading("a", said), reading("b", brand)).alias("readings"))
    candidates = F.slice(F.array(F.lit("x"), F.lit("y")), F.lit(1), (F.col("p_size") % 3).cast("int"))
    return table(spark, sf, "part").select("p_partkey", prompts.headed(said, F.expr(_HEAD), kind).alias("prompt"), prompts.context(F.array(item(brand, kind), item(kind, F.lit(None).cast("string")))).alias("context"), prompts.packet(F.array(component)).alias("packet"), prompts.hypotheses_header(candidates).alias("header"))
