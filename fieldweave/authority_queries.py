"""Registered queries on names, places and clusters of like names, and their oracle SQL, which goes through all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S
from .operators import authority, resolve
from .registry import Register
from .sources.files import table

register = Register()


def _groups(c: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({c}), 1) + 1), lambda i: substr(' ' || {c} || ' ', i, 3)))"


def _cosine(a: str, b: str) -> str:
    return f"round(len(list_intersect({a}, {b})) / sqrt(CAST(len({a}) AS DOUBLE) * len({b})), 9)"


def _key(c: str) -> str:
    return rf"lower(regexp_replace({S.clean(c)}, '\s+', ' ', 'g'))"


_FIRST = r"regexp_extract(text, '^\\s*(\\S+\\s+\\S+\\s+\\S+)', 1)"


@register.add(rf"""WITH n AS (SELECT DISTINCT {S.clean(_FIRST.replace(chr(92) * 2, chr(92)))} AS name FROM documents), g AS (SELECT name, {_groups('name')} AS g FROM n WHERE name <> ''),
    p AS (SELECT a.name, b.name AS other FROM g a JOIN g b ON a.name <> b.name AND {_cosine('a.g', 'b.g')} >= 0.92),
    b AS (SELECT name, first(other ORDER BY length(other) DESC, other) AS other FROM p GROUP BY name)
    SELECT g.name, CASE WHEN length(other) > length(g.name) THEN other ELSE g.name END AS canonical FROM g LEFT JOIN b ON b.name = g.name""")
def name_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Like names under their longest form."""
    names = table(spark, sf, "documents").select(F.expr(_FIRST).alias("name"))
    return authority.clusters(names, "name")


# Names as they may be read: by key whole, cut, with other letters, of the genus only, blank, or unlike any.
_READ = """CASE p_partkey % 11 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN substr(p_name, 1, 1) || substr(p_name, 3) WHEN 3 THEN replace(p_name, 'e', 'q') WHEN 4 THEN substr(p_name, 1, instr(p_name, ' ')) || 'unknownia'
    WHEN 5 THEN '  ' WHEN 6 THEN p_type || p_brand WHEN 7 THEN p_name || 'xy' WHEN 8 THEN 'x' || p_name || ' xx' WHEN 9 THEN substr(p_name, 4) || ' x' ELSE NULL END"""
_KNOWN = "SELECT DISTINCT p_name AS name, CASE WHEN length(p_name) % 3 = 0 THEN 'accepted ' || p_name END AS accepted FROM part"


@register.add(f"""WITH r AS (SELECT DISTINCT v AS verbatim, {_key('v')} AS key, split_part({_key('v')}, ' ', 1) AS genus FROM (SELECT {_READ} AS v FROM part)),
    k AS (SELECT {_key('name')} AS key, min(name) AS name, min(accepted) AS accepted FROM ({_KNOWN}) GROUP BY 1),
    e AS (SELECT r.key, min({{'edits': levenshtein(r.key, k.key), 'of': k.key}}) AS near FROM (SELECT DISTINCT key FROM r WHERE key <> '') r JOIN k ON levenshtein(r.key, k.key) <= 2 GROUP BY 1),
    h AS (SELECT DISTINCT split_part(key, ' ', 1) AS genus FROM k),
    c AS (SELECT r.key, min({{'neg': -{_cosine('r.g', 'k.g')}, 'of': k.key}}) AS alike FROM (SELECT DISTINCT key, genus, {_groups('key')} AS g FROM r WHERE key <> '') r JOIN (SELECT key, {_groups('key')} AS g FROM k) k ON {_cosine('r.g', 'k.g')} >= 0.75
      WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.key = r.key) AND NOT EXISTS (SELECT 1 FROM h WHERE h.genus = r.genus) GROUP BY 1),
    j AS (SELECT r.*, near, h.genus IS NOT NULL AS has_genus, alike, CASE WHEN r.key = '' THEN 'EMPTY' WHEN near.edits = 0 THEN 'EXACT' WHEN near.edits > 0 THEN 'FUZZY' WHEN h.genus IS NOT NULL THEN 'HIGHERRANK' WHEN -alike.neg >= 0.92 THEN 'COSINE_HIGH' WHEN alike IS NOT NULL THEN 'COSINE_FLAG' ELSE 'NONE' END AS match_type
      FROM r LEFT JOIN e ON e.key = r.key LEFT JOIN h ON h.genus = r.genus LEFT JOIN c ON c.key = r.key),
    f AS (SELECT j.*, k.name, k.accepted AS other, match_type IN ('EXACT', 'FUZZY') AND k.accepted IS NOT NULL AS synonym, coalesce(near.of, CASE WHEN NOT has_genus THEN alike.of END) AS found FROM j LEFT JOIN k ON k.key = coalesce(near.of, CASE WHEN NOT has_genus THEN alike.of END))
    SELECT verbatim, CASE WHEN match_type = 'HIGHERRANK' THEN upper(substr(genus, 1, 1)) || substr(genus, 2) ELSE coalesce(name, '') END AS canonical, match_type,
      round(CASE match_type WHEN 'EXACT' THEN 1.0 WHEN 'FUZZY' THEN 1.0 - near.edits / greatest(length(key), length(found)) WHEN 'HIGHERRANK' THEN 0.5 ELSE coalesce(-alike.neg, 0.0) END, 6) AS confidence, synonym,
      CASE WHEN synonym THEN 'synonym_match' WHEN match_type = 'HIGHERRANK' THEN 'only_higherrank_match' WHEN match_type = 'COSINE_HIGH' THEN 'fallback_cosine_auto' WHEN match_type = 'COSINE_FLAG' THEN 'fallback_cosine_flag_for_review' WHEN match_type = 'NONE' THEN 'no_match' ELSE '' END AS warning FROM f""")
def name_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Names against a table of accepted ones, by bands of likeness."""
    parts = table(spark, sf, "part")
    read, known = parts.selectExpr(f"{_READ} AS name"), parts.selectExpr("p_name AS name", "CASE WHEN length(p_name) % 3 = 0 THEN 'accepted ' || p_name END AS accepted").distinct()
    return authority.matched(read, known).drop("accepted")


_PLACE = """CASE c_custkey % 7 WHEN 0 THEN n_name WHEN 1 THEN 'n' || CAST(n_nationkey AS STRING) WHEN 2 THEN 'near ' || lower(n_name) || ', the west' WHEN 3 THEN n_name || '0' WHEN 4 THEN '' WHEN 5 THEN 'xyz' ELSE n_name || ' land' END"""
_STATE = """CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) || 's' WHEN 2 THEN NULL WHEN 3 THEN 'nowhere' ELSE c_mktsegment || ' x' END"""


@register.add(f"""WITH v AS (SELECT DISTINCT {_PLACE} AS country, {_STATE} AS state FROM customer JOIN nation ON c_nationkey = n_nationkey),
    a AS (SELECT *, {_key('country')} AS ck, {_key('state')} AS sk FROM v), c AS (SELECT {_key('n_name')} AS key, n_name AS name, 'N' || n_nationkey AS code, {_groups(_key('n_name'))} AS g FROM nation),
    s AS (SELECT DISTINCT {_key('c_mktsegment')} AS key, c_mktsegment AS name, 'N' || c_nationkey AS code, {_groups(_key('c_mktsegment'))} AS g FROM customer),
    k AS (SELECT ck, {_groups('ck')} AS g FROM (SELECT DISTINCT ck FROM a WHERE ck <> '')),
    exact AS (SELECT ck, min({{'name': name, 'code': code}}) AS entry FROM k JOIN c ON ck = key OR ck = lower(code) GROUP BY 1),
    inside AS (SELECT ck, first({{'name': name, 'code': code}} ORDER BY length(key) DESC, name) AS entry FROM k JOIN c ON contains(' ' || regexp_replace(ck, '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g') || ' ', ' ' || regexp_replace(key, '[^\\p{{L}}\\p{{N}} ]+', ' ', 'g') || ' ') AND NOT regexp_matches(key, '[^\\p{{L}}\\p{{N}} ]') GROUP BY 1),
    alike AS (SELECT ck, first({{'name': name, 'code': code}} ORDER BY {_cosine('k.g', 'c.g')} DESC, key) AS entry, max({_cosine('k.g', 'c.g')}) AS cosine FROM k JOIN c ON {_cosine('k.g', 'c.g')} >= 0.75 GROUP BY 1),
    f AS (SELECT a.*, coalesce(e.entry, i.entry, l.entry) AS entry, CASE WHEN a.ck = '' THEN 'EMPTY' WHEN e.entry IS NOT NULL THEN 'exact' WHEN i.entry IS NOT NULL THEN 'substring' WHEN l.cosine >= 0.92 THEN 'cosine' WHEN l.entry IS NOT NULL THEN 'cosine_flag' ELSE 'no_match' END AS country_method
      FROM a LEFT JOIN exact e ON e.ck = a.ck LEFT JOIN inside i ON i.ck = a.ck LEFT JOIN alike l ON l.ck = a.ck),
    o AS (SELECT key, name, code, g FROM s UNION SELECT key, name, '', g FROM s),
    w AS (SELECT DISTINCT sk, coalesce(entry.code, '') AS code, {_groups('sk')} AS g FROM f WHERE sk <> ''),
    b AS (SELECT w.sk, w.code, first(name ORDER BY {_cosine('w.g', 'o.g')} DESC, key, name) AS name, max({_cosine('w.g', 'o.g')}) AS cosine FROM w JOIN o ON o.code = w.code AND {_cosine('w.g', 'o.g')} >= 0.75 GROUP BY 1, 2)
    SELECT country, state, coalesce(entry.name, '') AS country_canonical, country_method, coalesce(b.name, '') AS state_canonical, CASE WHEN f.sk = '' THEN 'EMPTY' WHEN b.cosine >= 0.92 THEN 'cosine' WHEN b.cosine IS NOT NULL THEN 'cosine_flag' ELSE 'no_match' END AS state_method
    FROM f LEFT JOIN b ON b.sk = f.sk AND b.code = coalesce(entry.code, '')""")
def place_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Countries, and states within them, against a table of places."""
    customers = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations at any scale
    values = customers.selectExpr(f"{_PLACE} AS country", f"{_STATE} AS state")
    code = F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code")
    countries = table(spark, sf, "nation").select(F.lit("country").alias("kind"), F.col("n_name").alias("name"), code)
    states = customers.select(F.lit("state").alias("kind"), F.col("c_mktsegment").alias("name"), code).distinct()
    return authority.placed(values, countries.unionByName(states))


@register.add("""WITH r AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\p{L}\\p{N}]', '.', 'g'), '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Z][a-zA-Z\\-]+(?:\\s+[A-Z][a-zA-Z\\-]+){0,3}\\b') AS runs FROM documents)
    SELECT doc_id, array_to_string(list_slice(list_filter(runs, lambda x: upper(x) NOT IN ('HERBARIUM', 'MUSEUM', 'NATURAL', 'HISTORY', 'TYPE', 'HOLOTYPE', 'ISOTYPE', 'LECTOTYPE', 'DET', 'LEG', 'COLLECTOR', 'COLL', 'LOCALITY')), 1, 8), '|') AS nouns FROM r""")
def proper_nouns(spark: SparkSession, sf: str) -> DataFrame:
    """The first runs of capitalised words of each document."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(authority.proper_nouns(F.col("text")), "|").alias("nouns"))


_NAMES = """CASE o_orderkey % 7 WHEN 0 THEN 'Rosa canina' WHEN 1 THEN 'Abies  alba' WHEN 2 THEN '' WHEN 3 THEN 'Poa annua (L.) x' WHEN 4 THEN 'poa annua' WHEN 5 THEN NULL ELSE 'Carex lutea' END"""
_LANDS = "CASE o_orderkey % 5 WHEN 0 THEN 'UK' WHEN 1 THEN ' Cuba ' WHEN 2 THEN 'nan' WHEN 3 THEN 'u.s.a.' ELSE 'France' END"
_ID = "CASE o_orderkey % 4 WHEN 0 THEN 'E' || CAST(100000 + o_orderkey AS STRING) WHEN 1 THEN 'E' || CAST(1000 + o_orderkey % 9000 AS STRING) WHEN 2 THEN '' ELSE '12-34' END"
_OTHER = "'E' || CAST(100000 + l_orderkey AS STRING) || CAST(l_linenumber % 2 AS STRING)"
_SURE = "CASE o_orderkey % 3 WHEN 0 THEN '0.4' WHEN 1 THEN '0.9' ELSE 'high' END"
_LISTED = [("Rosa canina L.", None), ("Abies alba Mill.", None), ("Poa annua L.", "x"), ("Poa annua A.", None), ("Quercus robur", None)]


def _binomial(c: str) -> str:
    squeezed = rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
    return rf"CASE WHEN regexp_extract({squeezed}, '^[A-Z][a-zA-Z\-]+ [a-z][a-zA-Z\-]+') = '' THEN {squeezed} ELSE regexp_extract({squeezed}, '^[A-Z][a-zA-Z\-]+ [a-z][a-zA-Z\-]+') END"


@register.add(rf"""WITH i AS (SELECT o_orderkey AS record, CASE WHEN o_orderkey % 2 = 0 THEN 'model' ELSE 'rule' END AS method, {S.clean(_ID)} AS id, {_SURE} AS sure, {S.clean(_NAMES)} AS name, {S.clean(_LANDS)} AS land FROM orders),
    x AS (SELECT DISTINCT l_orderkey AS record, {_OTHER} AS reading FROM lineitem),
    e AS (SELECT record, id, count(reading) FILTER (WHERE fits) AS n, min(reading) FILTER (WHERE fits) AS one FROM (SELECT i.record, i.id, reading, regexp_full_match(upper(id), '[A-Z]{{1,4}}[0-9]{{4,14}}') AND length(reading) - length(id) BETWEEN 1 AND 4 AND starts_with(reading, upper(id)) AS fits FROM i LEFT JOIN x ON x.record = i.record) GROUP BY 1, 2),
    k AS (SELECT lower({_binomial('name')}) AS two, min(name) AS listed FROM (VALUES {', '.join(f"('{n}')" for n, _ in _LISTED)}) t(name) GROUP BY 1),
    j AS (SELECT i.*, n, one, listed, {_binomial('name')} AS canonical, CASE WHEN listed IS NOT NULL THEN listed ELSE name END AS better FROM i JOIN e ON e.record = i.record
      LEFT JOIN k ON k.two = lower({_binomial('name')}) AND i.method = 'model' AND regexp_matches(name, '^[A-Z][a-zA-Z\-]+\s+[a-z][a-zA-Z\-]+(\s|$)'))
    SELECT record, method, CASE WHEN n = 1 THEN one ELSE id END AS "catalogNumber", id AS "catalogNumber_verbatim", CASE WHEN id = '' THEN 'not_provided' WHEN NOT regexp_full_match(regexp_replace(upper(id), '[^A-Z0-9]', '', 'g'), '[A-Z]{{1,4}}[0-9]{{4,14}}') THEN 'original_not_structured' WHEN n = 1 THEN 'strict_extension_applied' WHEN n > 1 THEN 'ambiguous_extension' ELSE 'no_safe_extension' END AS catalog_number_resolution_status,
      CASE WHEN n = 1 THEN greatest(coalesce(TRY_CAST(sure AS DOUBLE), 0), 0.85) ELSE coalesce(TRY_CAST(sure AS DOUBLE), 0) END AS "catalogNumber_confidence", better AS "scientificName", name AS "scientificName_verbatim", {_binomial('better')} AS "scientificName_canonical",
      CASE WHEN name = '' THEN 'not_provided' WHEN better <> name THEN 'authority_authorship_corrected' WHEN listed IS NOT NULL THEN 'authority_checked_unchanged' ELSE 'local_canonical' END AS taxonomy_match_status, better <> name AS taxonomy_correction_applied, land AS country_verbatim,
      CASE lower(land) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in resolve.COUNTRIES.items())} ELSE land END AS country_normalised, '' AS "stateProvince_normalised" FROM j""")
def reconciled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with completed identifiers, names by an authority table and usual names of countries; what was read stays."""
    orders = table(spark, sf, "orders")
    method = F.when(F.col("o_orderkey") % 2 == 0, "model").otherwise("rule")
    rows = orders.select(F.col("o_orderkey").alias("record"), method.alias("method"), F.expr(_ID).alias("catalogNumber"), F.expr(_SURE).alias("catalogNumber_confidence"), F.expr(_NAMES).alias("scientificName"), F.expr(_LANDS).alias("country"), F.lit(None).cast("string").alias("stateProvince"))
    readings = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.expr(_OTHER).alias("reading"), F.col("l_linenumber").alias("pos"))
    extensions = resolve.safe_extension(rows, readings, "record", "catalogNumber", "reading", "pos")
    return authority.reconciled(rows, spark.createDataFrame(_LISTED, "name string, accepted string"), extensions, ["model"])
