"""Blocks of documents and what they ask of the whole corpus.

A block is a row of its own: a few MB of texts, worked on with numpy. Where a block needs a figure that all documents make
together (the count of a word, of a pair), it sends its distinct keys with its own sums, dealt to parts by key; the task of a
part adds them up and answers each block in the order of its keys. So every key travels once a block, however often it
occurs, and no task sees more than its share of distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, tidy

Answer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, ...]]


def pack(values: np.ndarray, deltas: bool = False) -> bytes:
    """Whole numbers from 0 on, as byte planes of the least width, compressed; of ascending ones the differences."""
    values = np.asarray(values).astype(np.uint64)
    if deltas and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width, deltas]) + len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    """The numbers of pack(), as unsigned 64-bit integers."""
    width, deltas, n = packed[0], packed[1], int.from_bytes(packed[2:10], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[10:], decompressed_size=width * n, asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    values = out.view("<u8").ravel()
    return np.cumsum(values, dtype=np.uint64) if deltas else values


class Bits:
    """A packed bitset with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, positions: np.ndarray, size: int) -> Bits:
        marks = np.zeros(size // 64 * 64 + 64, bool)  # ranks may be asked at `size` itself
        marks[positions] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def rank(self, positions: np.ndarray) -> np.ndarray:
        """Bits set before each position."""
        word, bit = positions >> 6, (positions & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def select(self) -> np.ndarray:
        """Positions of all bits set."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def pack_values(values: np.ndarray) -> list[bytes]:
    """Numbers of which few differ: the different ones, frequent first, and the indices of all in those."""
    distinct, where, count = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return [pack(distinct[order]), pack(rank[where])]


def unpack_values(packed: list[bytes]) -> np.ndarray:
    return unpack(packed[0])[unpack(packed[1]).astype(np.int64)]


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` bytes made from smaller ones."""
    have: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        have.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(have).combine_chunks().to_batches()[0]
            have, size = [], 0
    have = [b for b in have if len(b)]
    if have:
        yield pa.Table.from_batches(have).combine_chunks().to_batches()[0]


def block_ids() -> Iterator[int]:
    """Numbers of the blocks of a task, unlike those of other tasks."""
    first = TaskContext.get().partitionId() << 32
    return iter(range(first, first + (1 << 32)))


def dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(parts)).astype(np.int64)


def by_part(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts the keys of each part together, and where each part starts in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of sorted batches, those with one value of `column` at a time."""
    own: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if own and own[0][column] != row[column]:
                yield own[0][column], own
                own = []
            own.append(row)
    if own:
        yield own[0][column], own


def asked(blocks: DataFrame, parts: int, place: Callable[[np.ndarray, int], np.ndarray], answer: Answer, figures: Callable[[np.ndarray, np.ndarray], list[int]] | None = None) -> DataFrame:
    """block, part, answers, figures: what the corpus says to each block's `keys` (packed, all different), given the blocks' `sums` of each.

    `place` deals keys to parts; `answer` gets a part's distinct keys and their sums over all blocks, and gives an array for
    each answer, with a value a key. `figures` of a part stand on its first row only, so that they can be added up.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, sums = unpack(row["keys"]), unpack(row["sums"])
                order, at = by_part(place(keys, parts), parts)
                spans = [(p, order[at[p] : at[p + 1]]) for p in range(parts) if at[p + 1] > at[p]]
                if spans:
                    out = [[p for p, _ in spans], [row["block"]] * len(spans), [pack(keys[o], True) for _, o in spans], [pack(sums[o]) for _, o in spans]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "keys", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in runs_of(batches, "part"):
            keys = [unpack(r["keys"]) for r in rows]
            distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, where, np.concatenate([unpack(r["sums"]) for r in rows]).astype(np.int64))
            given = answer(distinct, sums)
            ends = np.cumsum([len(k) for k in keys])
            said = figures(distinct, sums) if figures else None
            for row, k, end in zip(rows, keys, ends, strict=True):
                packed = [pack(g[where[end - len(k) : end]]) for g in given]
                cells = [pa.array([row["block"]], pa.int64()), pa.array([part], pa.int32()), pa.array([packed], pa.list_(pa.binary())), pa.array([said], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cells, ["block", "part", "answers", "figures"])
                said = None

    sent = blocks.select("block", "keys", "sums").mapInArrow(ask, "part int, block long, keys binary, sums binary")
    return sent.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(tidy(merge), "block long, part int, answers array<binary>, figures array<long>")


def answered(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """The blocks with a column `answers` (part, answers); none where a block asked nothing."""
    own = replies.groupBy("block").agg(F.collect_list(F.struct("part", "answers")).alias("answers"))
    return blocks.join(own, "block", "left")


def in_order(answers: list[dict] | None, part: np.ndarray, kinds: int) -> list[np.ndarray]:
    """The answers in the order of the block's keys; `part`: where asked() had dealt them."""
    out = [np.zeros(len(part), np.uint64) for _ in range(kinds)]
    order = np.argsort(part, kind="stable")
    at = 0
    for given in sorted(answers or [], key=lambda x: x["part"]):
        arrays = [unpack(x) for x in given["answers"]]
        for k, x in enumerate(arrays):
            out[k][order[at : at + len(x)]] = x
        at += len(arrays[0])
    return out
