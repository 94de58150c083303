"""Connected components by alternating large-star and small-star steps, and a fixed-size membership filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, stored, tidy


def _is_star(pairs: DataFrame) -> bool:
    """Every u has one v, and no v is a u."""
    ends = pairs.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter("below > 1 or (below = 1 and above = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b). Labels stay distributed."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs = stored(pairs, "edges")
    while not _is_star(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = stored(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = stored(small.filter("u <> v").distinct(), "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def only_held(rows: DataFrame, ids: DataFrame, most_words: int = 1 << 20, both: bool = False):
    """Rows whose doc_id is among `ids` (doc_id), and few others: a Bloom filter of at most `most_words` 64-bit words.

    It spares a later join most of the texts; where there are more ids than it can tell apart it lets more rows through.
    With `both`, also the other rows, as a second frame.
    """
    n = ids.count()
    words = 1 << 10
    while words < most_words and 64 * words < 24 * n:
        words *= 2

    def places(values: np.ndarray) -> np.ndarray:
        x = values.astype(np.int64).view(np.uint64)
        return np.stack([mix64(x + np.uint64(seed)) % np.uint64(64 * words) for seed in (1, 2, 3)])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column("doc_id").to_numpy(zero_copy_only=False)).ravel()
            order = np.argsort(at)
            at = at[order]
            where = (at >> np.uint64(6)).astype(np.int64)
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(where[first]), pa.array(bits.view(np.int64))], ["word", "bits"])

    got = ids.select("doc_id").mapInArrow(tidy(fill), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(words, np.int64)
    filled[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(filled.view(np.uint64))

    def test(batches: Iterator[pa.RecordBatch], wanted: bool = True) -> Iterator[pa.RecordBatch]:
        have = sent.value
        for batch in batches:
            col = batch.column("doc_id")
            at = places(col.fill_null(0).to_numpy(zero_copy_only=False))
            hit = ((have[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(0)
            yield batch.filter(pa.array((hit & col.is_valid().to_numpy(zero_copy_only=False)) == wanted))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return test(batches, False)

    held = rows.mapInArrow(tidy(test), rows.schema)
    return (held, rows.mapInArrow(tidy(rest), rows.schema)) if both else held


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't among `ids` (doc_id); only rows that the filter takes for such are shuffled."""
    ids = ids.select("doc_id").distinct()
    held, rest = only_held(rows, ids, both=True)
    return rest.unionByName(held.join(ids, "doc_id", "left_anti").select(*rows.columns))
