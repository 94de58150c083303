"""Suffix-array deduplication (operator 8): bytes that a string of `length` bytes covers which also starts elsewhere.

Equal strings have equal content, so the k-gram of least hash inside a string of `length` bytes stands at the same place in
all its copies: its anchor. Starts with one anchor form a run, about 170 bytes of them; a run whose anchor occurs nowhere
else holds no repeat, and only the others go on. Runs with equal surroundings are copies as a whole and stand for one; the
distinct surroundings of an anchor meet in one bucket of bounded size, where a two-stage suffix sort and adjacent common
prefixes find repeated strings. An anchor with very many surroundings is dealt to several buckets; strings that are single in
their bucket are then compared by hash across them.

Passages counted in words are found by the same anchors over words; the windows of runs that share an anchor are compared by
64-bit hashes of their bytes.

Null and empty texts are empty; texts shorter than `length` lose nothing; repeated rows are copies of one another; a null
doc_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mix64, prefix_hash, ragged, release, span_hash, stored, sub_batches, tidy, utf8, words_of
from .graph import only_held
from .suffix_array import STOP, common_prefixes, sort

GRAM = 64
#: Words of an anchor of passages that are counted in words.
GRAM_WORDS = 8
#: Bytes of surroundings that one bucket gets on average, and surroundings of one anchor in a bucket at most, on average.
BUCKET_BYTES = 1 << 20
BUCKET_MEMBERS = 6000


def _anchored(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the least of the `window` hashes from each start on, and the first and last of each run of starts that share it."""
    n = len(hashes)
    bits = np.uint64(int(n).bit_length())
    value = np.full(-(-n // window) * window + window, np.iinfo(np.uint64).max, np.uint64)
    value[:n] = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    blocks = value.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[starts], ahead[starts + window - 1]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    return anchor, first, np.append(first[1:], len(starts)) - 1


def _runs_of(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text, first and last start, anchor, hash of the anchor, hash of the surroundings."""
    n, window = len(buf), length - GRAM + 1
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = prefix_hash(buf)
    at = np.arange(n - GRAM + 1)
    hashes = span_hash(prefix, at, at + GRAM)
    starts = ragged(offsets[:-1], np.maximum(sizes - length + 1, 0))
    anchor, first, last = _anchored(hashes, starts, window)
    p1, p2, a = starts[first], starts[last], anchor[first]
    around = mix64(span_hash(prefix, p1, p2 + length) + mix64(((a - p1) * 65536 + (p2 - p1)).astype(np.uint64)))
    doc = np.searchsorted(offsets, p1, side="right") - 1
    base = offsets[doc]
    return doc, p1 - base, p2 - base, a - base, hashes[a].view(np.int64), around.view(np.int64)


def _runs(docs: DataFrame, length: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, 1 << 19):
                buf, offsets = utf8(part)
                doc, p1, p2, a, anchor, around = _runs_of(buf, offsets, length)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(anchor), pa.array(around), pa.array(a.astype(np.int32)), pa.array((a - p1).astype(np.int32)), pa.array((p2 - p1 + 1).astype(np.int32))],
                    ["doc_id", "text_hash", "anchor", "around", "at", "lead", "starts"],
                )

    return docs.mapInArrow(tidy(cut), "doc_id long, text_hash long, anchor long, around long, at int, lead int, starts int")


def _surroundings(classes: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of one member of each class."""
    wanted = classes.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "around", "at", "lead", "starts", "part")).alias("want"))
    texts = only_held(docs, classes.select("doc_id").distinct()).dropDuplicates(["doc_id", "text_hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                rows = []
                for text, want in zip(part.column("text").to_pylist(), part.column("want").to_pylist(), strict=True):
                    raw = text.encode()
                    for w in want:
                        start = w["at"] - w["lead"]
                        rows.append((w["anchor"], w["around"], w["lead"], w["starts"], w["part"], raw[start : start + w["starts"] - 1 + length]))
                names = ["anchor", "around", "lead", "starts", "part", "bytes"]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                cols = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return texts.join(wanted, ["doc_id", "text_hash"]).select("text", "want").mapInArrow(tidy(cut), "anchor long, around long, lead int, starts int, part int, bytes binary")


def repeated_starts(pieces: list[bytes], starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the first `starts` positions of each piece, in order: position in the joined text, repeated or not, one of each distinct string or not; and the text."""
    buf = np.frombuffer(b"".join(p + bytes([STOP]) for p in pieces), np.uint8)
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    at = ragged(np.cumsum(sizes) - sizes, starts)
    slot = np.full(len(buf), -1, np.int64)
    slot[at] = np.arange(len(at))
    order = sort(buf, length, slot >= 0)
    order = order[slot[order] >= 0]
    same = common_prefixes(buf, order, length) >= length
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    out, one = np.zeros(len(at), bool), np.zeros(len(at), bool)
    out[slot[order]] = repeated
    one[slot[order]] = ~same
    return at, out, one, buf


def _search(around: DataFrame, length: int, buckets: int) -> DataFrame:
    """(anchor, around, first, last, gram): repeated starts from the anchor, or (gram not null) one start to compare across buckets."""
    schema = pa.schema([("anchor", pa.int64()), ("around", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("gram", pa.int64()), ("single", pa.bool_())])

    def search(group: pa.Table) -> pa.Table:
        release()  # what the bucket before left
        pieces = group.column("bytes").to_pylist()
        lead, starts = (group.column(c).to_numpy().astype(np.int64) for c in ("lead", "starts"))
        anchor, key, split = (group.column(c).to_numpy() for c in ("anchor", "around", "part"))
        at, repeated, one, buf = repeated_starts(pieces, starts, length)
        row = np.repeat(np.arange(len(pieces)), starts)
        step = np.arange(len(at)) - np.repeat(np.cumsum(starts) - starts, starts) - lead[row]
        edge = np.flatnonzero(repeated)
        new = np.concatenate([[True], (np.diff(edge) != 1) | (row[edge[1:]] != row[edge[:-1]])]) if len(edge) else np.zeros(0, bool)
        lo = edge[new]
        hi = edge[np.append(np.flatnonzero(new)[1:], len(edge)) - 1] if len(edge) else lo
        wide = np.flatnonzero((split[row] >= 0) & one)
        gram = span_hash(prefix_hash(buf), at[wide], at[wide] + length).view(np.int64) if len(wide) else np.zeros(0, np.int64)
        rows = np.concatenate([row[lo], row[wide]])
        cols = [anchor[rows], key[rows], np.concatenate([step[lo], step[wide]]).astype(np.int32), np.concatenate([step[hi], step[wide]]).astype(np.int32)]
        grams = pa.array(np.concatenate([np.zeros(len(lo), np.int64), gram]), mask=np.concatenate([np.ones(len(lo), bool), np.zeros(len(wide), bool)]))
        single = np.concatenate([np.zeros(len(lo), bool), ~repeated[wide]])
        return pa.table([*map(pa.array, cols), grams, pa.array(single)], schema=schema)

    keyed = around.withColumn("bucket", F.pmod(F.xxhash64("anchor", "part"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInArrow(search, "anchor long, around long, first int, last int, gram long, single boolean")


def find(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, text_hash, first, last): starts of repeated strings, by document."""
    runs = stored(_runs(docs, length), "runs")
    # A table of its own: with its aggregation in the join's stage, a frequent anchor could not be split.
    twice = stored(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "twice")
    shared = stored(runs.join(twice, "anchor"), "shared")
    one = F.min(F.struct("doc_id", "text_hash", "at", "lead", "starts")).alias("one")
    classes = stored(shared.groupBy("anchor", "around").agg(F.count("*").alias("n"), one).select("anchor", "around", "n", "one.*"), "classes")
    several = classes.groupBy("anchor").agg(F.count("*").alias("members"), F.sum(F.col("starts") + length - 1).alias("bytes")).filter("members > 1")
    several = stored(several, "several")
    total = several.agg(F.sum("bytes")).first()[0] or 0
    parts = F.ceil(F.col("members") / BUCKET_MEMBERS).cast("int")
    dealt = classes.join(several.select("anchor", "members"), "anchor").withColumn("part", F.when(parts > 1, F.pmod("around", parts)).otherwise(-1).cast("int"))
    around = _surroundings(dealt.drop("n", "members"), docs, length)
    found = stored(_search(around, length, max(1, -(-total // BUCKET_BYTES))), "found")
    grams = found.filter("gram is not null")
    across = grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    across = grams.filter("single").join(across, "gram").select("anchor", "around", "first", "last")
    parts_of = found.filter("gram is null").select("anchor", "around", "first", "last").unionByName(across)
    # Of a class with several members every start repeats; of the others, what the buckets found.
    whole = shared.join(classes.filter("n > 1").select("anchor", "around"), ["anchor", "around"])
    whole = whole.select("doc_id", "text_hash", (F.col("at") - F.col("lead")).alias("first"), (F.col("at") - F.col("lead") + F.col("starts") - 1).alias("last"))
    single = classes.filter("n = 1").join(parts_of, ["anchor", "around"])
    single = single.select("doc_id", "text_hash", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last"))
    return whole.unionByName(single)


def _passage_runs(docs: DataFrame, words: int) -> DataFrame:
    """Runs of windows of `words` words with one anchor: the bytes they cover, the number of windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, 1 << 19):
                buf, offsets = utf8(part)
                starts, ends, rows = words_of(buf, offsets)
                sizes = np.diff(rows)
                if not (sizes >= words).any():
                    continue
                prefix = prefix_hash(buf)
                hashes = span_hash(prefix, starts[: len(starts) - GRAM_WORDS + 1], ends[GRAM_WORDS - 1 :])
                at = ragged(rows[:-1], np.maximum(sizes - words + 1, 0))
                anchor, first, last = _anchored(hashes, at, words - GRAM_WORDS + 1)
                a, n = anchor[first], last - first + 1
                p1, p2 = starts[at[first]], ends[at[last] + words - 1]
                around = mix64(span_hash(prefix, p1, p2) + mix64(((starts[a] - p1) * 65536 + n).astype(np.uint64)))
                doc = np.searchsorted(rows, at[first], side="right") - 1
                base, take = offsets[doc], pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array(hashes[a].view(np.int64)), pa.array(around.view(np.int64)), pa.array((p1 - base).astype(np.int32)), pa.array((p2 - base).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["doc_id", "text_hash", "anchor", "around", "first", "end", "windows"],
                )

    return docs.mapInArrow(tidy(cut), "doc_id long, text_hash long, anchor long, around long, first int, end int, windows int")


def _passages_in(classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, first, end, gram, single): every window of one member of each class, by its hash."""
    wanted = classes.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "windows", "single")).alias("want"))
    texts = only_held(docs, classes.select("doc_id").distinct()).dropDuplicates(["doc_id", "text_hash"])
    names = ["doc_id", "text_hash", "first", "end", "gram", "single"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                buf, offsets = utf8(part)
                starts, ends, rows = words_of(buf, offsets)
                want = part.column("want").to_pylist()
                doc = np.repeat(np.arange(len(part)), [len(w) for w in want])
                first, n, single = (np.array([x[k] for w in want for x in w], t) for k, t in (("first", np.int64), ("windows", np.int64), ("single", bool)))
                at = ragged(np.searchsorted(starts, offsets[doc] + first), n)
                doc, single = np.repeat(doc, n), np.repeat(single, n)
                p1, p2 = starts[at], ends[at + words - 1]
                gram, take = span_hash(prefix_hash(buf), p1, p2).view(np.int64), pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("text_hash").take(take), pa.array((p1 - offsets[doc]).astype(np.int32)), pa.array((p2 - offsets[doc]).astype(np.int32)), pa.array(gram), pa.array(single)], names)

    held = texts.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "want")
    return held.mapInArrow(tidy(cut), "doc_id long, text_hash long, first int, end int, gram long, single boolean")


def find_passages(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, first, end): bytes of strings of `words` whole words that stand elsewhere too, however short they are."""
    runs = stored(_passage_runs(docs, words), "passage-runs")
    twice = stored(runs.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "passage-twice")
    shared = stored(runs.join(twice, "anchor"), "passage-shared")
    one = F.min(F.struct("doc_id", "text_hash", "first", "end", "windows")).alias("one")
    classes = stored(shared.groupBy("anchor", "around").agg(F.count("*").alias("n"), one).select("anchor", "around", "n", "one.*"), "passage-classes")
    several = stored(classes.groupBy("anchor").agg(F.count("*").alias("members")).filter("members > 1").select("anchor"), "passage-several")
    dealt = classes.join(several, "anchor").select("doc_id", "text_hash", "first", "windows", (F.col("n") == 1).alias("single"))
    grams = stored(_passages_in(dealt, docs, words), "passages")
    again = stored(grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "passages-again")
    parts = grams.filter("single").join(again, "gram").select("doc_id", "text_hash", "first", "end")
    whole = shared.join(classes.filter("n > 1").select("anchor", "around"), ["anchor", "around"]).select("doc_id", "text_hash", "first", "end")
    return whole.unionByName(parts)


def _united(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """The spans in order, those that meet or overlap as one."""
    runs: list[list[int]] = []
    for first, end in sorted(spans):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])
    return runs


def remove(docs: DataFrame, length: int = 400, carry: tuple[str, ...] = (), words: int | None = None, characters: bool = False, reported: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes), kept (the other bytes) of every document, and the columns to carry.

    With `words`, strings of so many words that stand elsewhere too go also where they are shorter than `length`. With
    `characters`, a character that loses some of its bytes loses all. With `reported`, a column `passages` names the runs of
    bytes of strings of so many words that stand elsewhere too; nothing is removed on its account.
    """
    docs = id_text(docs, *carry).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry)
    # A row is told by its id (a null one by the least long) and its text.
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"), F.col("doc_id").isNull().alias("no_id"), *carry)
    rows = keyed.select("doc_id", "text", "text_hash")
    found = find(rows, length).select("doc_id", "text_hash", "first", (F.col("last") + length).cast("int").alias("end"))
    if words:
        found = found.unionByName(find_passages(rows, words))
    found = found.withColumn("goes", F.lit(True))
    if reported:
        found = found.unionByName(find_passages(rows, reported).withColumn("goes", F.lit(False)))
    spans = stored(found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "end", "goes")).alias("starts")), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                sizes, spans_, kept, passages = [], [], [], []
                for text, starts in zip(part.column("text").to_pylist(), part.column("starts").to_pylist(), strict=True):
                    raw = text.encode()
                    runs, named = (_united((s["first"], s["end"]) for s in starts or () if s["goes"] == goes) for goes in (True, False))
                    for run in runs if characters else ():
                        while 0 < run[0] < len(raw) and raw[run[0]] & 0xC0 == 0x80:
                            run[0] -= 1
                        while run[1] < len(raw) and raw[run[1]] & 0xC0 == 0x80:
                            run[1] += 1
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    sizes.append(len(raw))
                    spans_.append([{"start": a, "end": b} for a, b in runs])
                    passages.append([{"start": a, "end": b} for a, b in named])
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                ids = part.column("doc_id")
                ids = pa.array(ids.to_numpy(zero_copy_only=False), pa.int64(), mask=part.column("no_id").to_numpy(zero_copy_only=False).astype(bool))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                cols = [ids, pa.array(sizes, pa.int64()), pa.array(spans_, kind), pa.array(kept, pa.binary()), *(part.column(c) for c in carry)]
                if reported:
                    cols.append(pa.array(passages, kind))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "spans", "kept", *carry, *(["passages"] if reported else [])])

    held, rest = only_held(keyed, spans.select("doc_id").distinct(), both=True)
    joined = held.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "no_id", "text", "starts", *carry)
    rest = rest.select("doc_id", "no_id", "text", F.lit(None).cast("array<struct<first:int,end:int,goes:boolean>>").alias("starts"), *carry)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in carry)
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary" + more + (", passages array<struct<start:long,end:long>>" if reported else "")
    return joined.mapInArrow(tidy(cut), schema).unionByName(rest.mapInArrow(tidy(cut), schema))
