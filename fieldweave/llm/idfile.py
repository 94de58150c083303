"""Token-id files (operator 2): ids coded by one canonical, length-limited Huffman code built from global counts.

Layout of a folder: `code` holds (id, length) of every id in use, from which both sides derive the same canonical code;
`blocks` holds independent blocks in ascending order of doc_id: document ids and lengths, the bits, and a bit offset for
every CHECKPOINT ids. A block decodes by itself: all its checkpoints advance together through one look-up table.

Documents are dealt by ranges of doc_id, so only ids (two bytes each where they fit) are shuffled, once. Nulls and empty
texts hold the end id alone; a null doc_id sorts first; repeated doc_ids stay apart, in any order; extra columns are
ignored; an empty table gives empty files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import gathered
from .common import id_text, shared_dir, stored, sub_batches, texts_of
from .tokens import Library

CHECKPOINT = 512
#: Ids after which a block is closed (a longer document still stays in one block).
BLOCK_IDS = 1 << 20
#: Longest code word; the look-up table has 2**MAX_BITS entries.
MAX_BITS = 18
#: Text bytes whose pieces are told apart at once.
SLICE_BYTES = 8 << 20


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("too many ids for the longest code word")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    levels: list[np.ndarray] = []
    packed = np.zeros(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weight, packed])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < len(weight))  # which items of this level are single ids
        merged = merged[rank]
        packed = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * (len(used) - 1)
    length = np.zeros(len(used), np.int64)
    for single in reversed(levels):
        chosen = int(single[:take].sum())
        length[:chosen] += 1  # single ids enter a level in the order of their weights
        take = 2 * (take - chosen)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words by length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for n, many in zip(*np.unique(lengths[order], return_counts=True), strict=True):
        code <<= int(n) - before
        at = np.searchsorted(lengths[order], n)
        codes[order[at : at + many]] = code + np.arange(many, dtype=np.uint64)
        code, before = code + int(many), int(n)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit offset of every CHECKPOINT-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    # A code word lies in one 64-bit word, or its last bits fall into the next.
    at, room = starts >> 6, 64 - (starts & 63) - n
    value = codes[ids]
    left = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(ids) else np.zeros(0, np.int64)
    if len(ids):
        words[at[first]] |= np.bitwise_or.reduceat(left, first)
        over = np.flatnonzero(room < 0)
        words[at[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], starts[::CHECKPOINT]


def look_up(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every window of MAX_BITS bits."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    span = np.left_shift(1, MAX_BITS - lengths[order].astype(np.int64))
    pad = (1 << MAX_BITS) - int(span.sum())
    return np.concatenate([np.repeat(order, span), np.zeros(pad, np.int64)]), np.concatenate([np.repeat(lengths[order].astype(np.int64), span), np.zeros(pad, np.int64)])


def unpack(bits: bytes, checkpoints: np.ndarray, n_ids: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block: its runs of CHECKPOINT ids are decoded side by side."""
    by_id, by_length = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.int64)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = checkpoints.astype(np.int64).copy()
    out = np.zeros((len(at), CHECKPOINT), np.uint32)
    last = n_ids - (len(at) - 1) * CHECKPOINT
    for k in range(CHECKPOINT):
        if k == last:
            at = at[:-1]
        if not len(at):
            break
        index = (window[at >> 3] >> (32 - MAX_BITS - (at & 7))) & ((1 << MAX_BITS) - 1)
        out[: len(at), k] = by_id[index]
        at = at + by_length[index]
    return out.reshape(-1)[:n_ids]


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    ids = docs.filter("doc_id is not null")
    return [int(x) for x in dict.fromkeys(ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))] if parts > 1 else []


def write(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int = 0) -> None:
    """Encodes whole texts, appends end_id to each document, and writes the folder."""
    spark = docs.sparkSession
    docs = id_text(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(_bounds(docs.select("doc_id"), parts), np.int64)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.of(tokenizer, pattern)
        kind = "<u2" if library.vocab_size <= 1 << 16 else "<u4"
        for batch in gathered(batches, SLICE_BYTES):
            for part in sub_batches(batch, SLICE_BYTES):
                ids, ends = library.encode(texts_of(part))
                ids = np.insert(ids, ends[1:], end_id).astype(kind)
                offsets = ((ends + np.arange(len(ends))) * ids.itemsize).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
                key = part.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.searchsorted(bounds, key, side="right").astype(np.int32)), pa.array([ids.itemsize] * len(part), pa.int8()), data], ["doc_id", "part", "width", "ids"])

    coded = docs.mapInArrow(tokens, "doc_id long, part int, width byte, ids binary")
    dealt = coded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id")
    raw = stored(dealt, "ids")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            width = batch.column("width")[0].as_py() if len(batch) else 2
            n = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}"), minlength=len(total))
            n[: len(total)] += total
            total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    # As many rows as the vocabulary has ids, whatever the input.
    rows = raw.select("width", "ids").mapInArrow(counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max([end_id, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        total[r["id"]] = r["n"]
    lengths = code_lengths(total, MAX_BITS)
    codes = canonical(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast((lengths, codes))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = code.value
        task, many = TaskContext.get().partitionId(), 0
        docs_: list[tuple] = []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal many
            ids = np.concatenate([r[2] for r in rows])
            bits, points = pack(ids, lengths, codes)
            many += 1
            one = {"block": (task << 32) + many, "part": rows[0][1], "first_doc": rows[0][0], "n_ids": len(ids), "doc_ids": [r[0] for r in rows], "doc_lengths": [len(r[2]) for r in rows], "checkpoints": points.astype("<u8").tobytes(), "bits": bits}
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one.values(), types, strict=True)], list(one))

        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        held = 0
        for batch in batches:
            width = batch.column("width")[0].as_py() if len(batch) else 2
            for doc, part, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "ids")), strict=True):
                # A block never crosses a range or a step back, which a task may meet where it reads several files.
                if docs_ and (part != docs_[-1][1] or (doc is not None and docs_[-1][0] is not None and doc < docs_[-1][0]) or held >= BLOCK_IDS):
                    yield block(docs_)
                    docs_, held = [], 0
                docs_.append((doc, part, np.frombuffer(data, f"<u{width}")))
                held += len(docs_[-1][2])
        if docs_:
            yield block(docs_)

    schema = "block long, part int, first_doc long, n_ids long, doc_ids array<long>, doc_lengths array<int>, checkpoints binary, bits binary"
    raw.mapInArrow(blocks, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), ids (binary, little-endian unsigned 32-bit integers), from the files."""
    rows = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]
    code = spark.sparkContext.broadcast(lengths)
    stored_blocks = spark.read.parquet(f"{path}/blocks")
    # Blocks are counted within their range of doc_ids; there are as many ranges as partitions, and their sums are few.
    index = stored_blocks.select("block", "part", "first_doc", "n_ids")
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("many")).collect()
    sums, blocks_in = {r["part"]: r["n"] for r in totals}, {r["part"]: r["many"] for r in totals}
    before, base = 0, []
    for part in range(max([-1, *sums]) + 1):
        base.append(before)
        before += sums.get(part, 0)
    order = Window.partitionBy("part").orderBy(F.col("first_doc").asc_nulls_first(), "block")
    inside = F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = index.select("block", (F.get(F.array(*map(F.lit, base or [0])), F.col("part")) + F.coalesce(inside, F.lit(0))).cast("long").alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = look_up(code.value, canonical(code.value))
        for batch in batches:
            for b in batch.to_pylist():
                ids = unpack(b["bits"], np.frombuffer(b["checkpoints"], "<u8"), b["n_ids"], table).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(b["doc_lengths"])]).astype(np.int64)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array([b["block"]] * (len(ends) - 1), pa.int64()), pa.array(b["doc_ids"], pa.int64()), pa.array(ends[:-1]), data], ["block", "doc_id", "local", "ids"])

    docs = stored_blocks.select("block", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "bits").mapInArrow(decode, "block long, doc_id long, local long, ids binary")
    # One row for each million ids or so: broadcast as long as that is little, else joined by a shuffle.
    many = sum(blocks_in.values())
    return docs.join(F.broadcast(starts) if many <= 1 << 20 else starts, "block").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "ids")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fieldweave/idfile-{uuid.uuid4().hex}"

