"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again for the next one.
Rows are told apart by doc_id and text, so those without a doc_id and those that share one are judged by their own texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import decontaminate, exact_dup, near_dup, quality
from fieldweave.llm.common import stored, table
from fieldweave.llm.graph import only_held, without
from fieldweave.llm.queries import encoded

#: Words of a passage that goes from the texts where it repeats; of fewer words, passages go from 400 bytes on.
PASSAGE_WORDS = 51
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key() -> Column:
    """Tells rows apart, those without a doc_id too; repeated rows share it."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows as the operators take them, under _key() in place of their doc_id."""
    return docs.select(_key().alias("doc_id"), "text")


def _leave_out(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose _key() isn't among `keys` (doc_id)."""
    return without(docs.select(_key().alias("doc_id"), F.struct(*COLUMNS).alias("row")), keys).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    docs = docs.select(*COLUMNS)
    return _leave_out(docs, stored(quality.judge(_keyed(docs)).filter("not kept").select("doc_id"), "rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the smallest doc_id (one without comes last), and one of repeated rows."""
    docs = docs.select(*COLUMNS)
    groups = stored(near_dup.group(_keyed(docs)).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")), "groups")
    ids = docs.select(_key().alias("key"), "doc_id").distinct()
    # Only groups of several keys need a choice; tables of their own, so that a large group can be split.
    several = stored(groups.groupBy("component").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo <> hi").select("component"), "several")
    members = stored(groups.distinct().join(several, "component"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("first")
    chosen = stored(members.join(ids, "key").groupBy("component").agg(first), "chosen")
    docs = _leave_out(docs, stored(members.join(chosen, "component").filter("key <> first").select(F.col("key").alias("doc_id")), "dropped"))
    again = stored(groups.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("doc_id")), "again")
    if again.isEmpty():
        return docs
    held, rest = only_held(docs.select(_key().alias("doc_id"), F.struct(*COLUMNS).alias("row")), again, both=True)
    return rest.unionByName(held.dropDuplicates(["doc_id"])).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that repeat go from the texts, and the other bytes of characters that lose some."""
    done = exact_dup.remove(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"), words=PASSAGE_WORDS, characters=True)
    text = F.col("kept").cast("string")
    return done.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    docs = docs.select(*COLUMNS)
    hit = decontaminate.scan(_keyed(docs), table(spark, sf_dir, "benchmark")).filter("n_hit > 0").select("doc_id")
    return _leave_out(docs, stored(hit, "leaks"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the bytes they decode to, as digests."""
    return encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("token ids", token_ids),
]

#: Estimated accuracies, signatures and suffix sorting have no SQL form; test_pipeline_run holds run() against plain Python (of the quality rules, verdicts on plain cases).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
