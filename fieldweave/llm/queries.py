"""The registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

import public_tokenizers as tokenizers_files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, conversation_trie, decontaminate, exact_dup, idfile, langid, near_dup, ngram_lm, quality, tokens, toxicity, url_filter
from .common import table


def encoded(docs: DataFrame) -> DataFrame:
    """Token ids of whole texts and the bytes they decode to, as digests."""
    ranks = bpe.RankMap(bpe.read_ranks(tokenizers_files.path("byte_bpe_50k.tiktoken")))
    done = bpe.encode(docs, ranks, tokenizers_files.PATTERN, decoded=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("ids_bytes", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op2_idfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = idfile.new_path(spark)
    idfile.write(table(spark, sf_dir, "documents"), path, tokenizers_files.path("byte_bpe_50k.json"), tokenizers_files.PATTERN)
    back = idfile.read(spark, path)
    return back.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizers_files.path("byte_bpe_50k.json"), tokenizers_files.PATTERN)
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.group(table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.judge(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Strings of 400 bytes are removed; passages of over 50 words, often shorter than that, are only counted.
    done = exact_dup.remove(table(spark, sf_dir, "documents"), reported=51)
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        "n_bytes",
        size("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        size("passages").alias("n_passage_bytes"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic")
    done = toxicity.score(table(spark, sf_dir, "documents"), labels)
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    done = langid.predict(docs, langid.fit(langid.learnable(docs, held_out)))
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _listed(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages: dates and actions follow from a digest of each host."""
    hosts = pages.select(url_filter.host(F.col("url")).alias("domain")).filter("domain is not null").distinct()
    digit = lambda k: F.expr(f"instr('0123456789abcdef', substr(md5(domain), {k}, 1)) - 1")
    start = F.lit("2024-01-01").cast("date")
    entry = lambda days, action: F.struct(F.date_add(start, days).alias("day"), F.lit(action).alias("action"))
    dated = F.array(entry(digit(1) * 11, "block"), entry(digit(1) * 11 + digit(2) * 7 + 1, "allow"), entry(digit(1) * 11 + digit(2) * 7 + digit(3) * 9 + 2, "block"))
    return hosts.select("domain", F.inline(dated))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    captures = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", fetched.alias("day"))
    return url_filter.judge(captures, _listed(pages))


OP10_SQL = r"""
WITH seen AS (
  SELECT page_id,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', ''), '') AS host,
         CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) AS day
  FROM pages),
hosts AS (
  SELECT DISTINCT host AS domain,
         instr('0123456789abcdef', substr(md5(host), 1, 1)) - 1 AS a,
         instr('0123456789abcdef', substr(md5(host), 2, 1)) - 1 AS b,
         instr('0123456789abcdef', substr(md5(host), 3, 1)) - 1 AS c
  FROM seen WHERE host IS NOT NULL),
entries AS (
  SELECT domain, DATE '2024-01-01' + CAST(a * 11 AS INTEGER) AS day, 0 AS allowed FROM hosts
  UNION ALL SELECT domain, DATE '2024-01-01' + CAST(a * 11 + b * 7 + 1 AS INTEGER), 1 FROM hosts
  UNION ALL SELECT domain, DATE '2024-01-01' + CAST(a * 11 + b * 7 + c * 9 + 2 AS INTEGER), 0 FROM hosts),
daily AS (SELECT domain, day, min(allowed) AS allowed FROM entries GROUP BY 1, 2),
valid AS (
  SELECT domain, day AS since, until FROM (
    SELECT *, lead(day) OVER (PARTITION BY domain ORDER BY day) AS until FROM daily) WHERE allowed = 0),
hits AS (
  SELECT s.page_id, v.domain, v.since,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(v.domain) DESC, v.domain DESC, v.since DESC) AS k
  FROM seen s JOIN valid v
    ON (s.host = v.domain OR (contains(v.domain, '.') AND ends_with(s.host, '.' || v.domain))) AND s.day >= v.since AND (v.until IS NULL OR s.day < v.until))
SELECT s.page_id, s.host, s.day, h.domain IS NOT NULL AS blocked, h.domain AS rule, CAST(h.since AS DATE) AS since
FROM seen s LEFT JOIN hits h ON s.page_id = h.page_id AND h.k = 1
"""


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link(table(spark, sf_dir, "documents"), tokenizers_files.path("byte_bpe_50k.json"), tokenizers_files.PATTERN, tokenizers_files.path("piece_bpe_32k.model"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.build(table(spark, sf_dir, "conversations"))


def op13_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    done = ngram_lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return done.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP12_SQL = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
                          lambda x, k: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1))) AS v
    FROM range(256) AS r(i))),
turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'role': role, 'text': text} ORDER BY k) AS seq FROM turns GROUP BY c),
takes AS (
  SELECT c, seq, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                 lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM own, crc_table),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(list_slice(b.seq, 1, a.h), []), list_slice(a.seq, a.h + 1, len(a.seq))) AS seq
  FROM takes a LEFT JOIN own b ON b.c = a.c - a.c % 5),
prefixes AS (
  SELECT c, d, list_slice(seq, 1, d) AS p, d = len(seq) AS ended FROM (
    SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, p, count(*) AS n_convs, min(c) AS conv_id, list_slice(p, 1, d - 1) AS up,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256,
         (count(*) - 1) * (CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].text) END) AS saved
  FROM prefixes GROUP BY d, p),
children AS (SELECT d - 1 AS d, up AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, u.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN children k ON k.d = n.d AND k.p = n.p LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.up AND n.d > 0),
sums AS (
  SELECT a.d, a.p, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens
  FROM full_nodes v JOIN prefixes a ON a.c = v.conv_id AND a.d <= v.d GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, n.parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.d = n.d AND s.p = n.p
"""


def queries() -> dict:
    return {
        "op1_bpe": op1_bpe,
        "op2_idfile": op2_idfile,
        "op3_toxicity": op3_toxicity,
        "op4_decontaminate": op4_decontaminate,
        "op5_tokens": op5_tokens,
        "op6_near_dup": op6_near_dup,
        "op7_quality": op7_quality,
        "op8_exact_dup": op8_exact_dup,
        "op9_langid": op9_langid,
        "op10_url_filter": op10_url_filter,
        "op11_alignment": op11_alignment,
        "op12_trie": op12_trie,
        "op13_lm": op13_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_url_filter": OP10_SQL.replace("\\\\", "\\"), "op12_trie": OP12_SQL}
