"""Byte-level BPE encoding and decoding (operator 1).

Distinct pieces of the corpus are folded once by Spark higher-order functions: the state is an array of longs, each a
token rank and the rank of the pair it forms with its right neighbour; every step merges the leftmost pair of lowest rank,
looked up in a literal rank map. The `max_hot` most frequent pieces travel to the tasks as one broadcast of that fixed size;
the distinct others of a batch ride on its first document and are folded there, so no text is shuffled. Decoding
concatenates the binary pieces of the ids.

Nulls and empty texts have no ids; a null doc_id is kept; repeated rows and ties are encoded row by row; extra columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, ragged, release, stored, sub_batches, texts_of, tidy, tidy_driver
from .pieces import split

#: Bits of one rank inside a packed long; a rank of all ones means "no pair".
_S = 20
_NONE = (1 << _S) - 1
_BUCKETS = 1 << 17
#: Pieces longer than this many bytes are merged by a heap instead of the fold, whose cost is quadratic.
MAX_FOLD_BYTES = 2048


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 bytes and the rank, one token a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankMap:
    """The rank map as literals of a plan: pairs of ranks in hash buckets, and ranks of single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        if max(ranks.values()) >= _NONE:
            raise ValueError("ranks do not fit the packed longs")
        buckets: list[list[int]] = [[] for _ in range(_BUCKETS)]
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    buckets[(left * 31 + right * 17) % _BUCKETS].append((left << _S | right) << _S | rank)
        self.pairs = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")
        self.bytes = F.from_json(F.lit(json.dumps([ranks[bytes([i])] for i in range(256)])), "array<bigint>")


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def fold_piece(piece: Column, ranks: RankMap) -> Column:
    """Token ids of one piece of text, by ranked merges over its bytes; the rank map stands in the plan once."""
    return _let(ranks.pairs, lambda pairs: _folded(piece, ranks.bytes, pairs))


def fold_pieces(pieces: Column, ranks: RankMap) -> Column:
    """Token ids of each piece of an array."""
    return _let(ranks.pairs, lambda pairs: F.transform(pieces, lambda piece: _folded(piece, ranks.bytes, pairs)))


def _folded(piece: Column, singles: Column, pairs: Column) -> Column:
    none = _long(_NONE)
    edge = F.array(_long(_NONE << _S | _NONE))

    def packed(left: Column, right: Column) -> Column:
        """Rank of the pair above, the left rank below."""
        bucket = F.get(pairs, F.pmod(left * 31 + right * 17, _long(_BUCKETS)).cast("int"))
        hit = F.filter(bucket, lambda x: F.shiftright(x, _S) == F.shiftleft(left, _S).bitwiseOR(right))
        rank = F.shiftleft(F.get(hit, F.lit(0)).bitwiseAND(none), _S)
        return F.coalesce(rank, _long(_NONE << _S)).bitwiseOR(left)

    raw = F.decode(F.encode(piece, "utf-8"), "iso-8859-1")
    single = F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.get(singles, F.ascii(F.substr(raw, i, F.lit(1)))))
    first = _let(single, lambda p: F.concat(edge, F.transform(p, lambda x, i: packed(x, F.coalesce(F.get(p, i + 1), none))), edge))

    def step(state: Column, _: Column) -> Column:
        def merged(lowest: Column) -> Column:
            rank = F.shiftright(lowest, _S)

            def at(k: Column) -> Column:
                before = F.get(state, k - 2).bitwiseAND(none)
                after = F.get(state, k + 1).bitwiseAND(none)
                return F.concat(F.slice(state, 1, k - 2), F.array(packed(before, rank), packed(rank, after)), F.slice(state, k + 2, F.size(state)))

            leftmost = F.array_position(F.transform(state, lambda x: F.shiftright(x, _S)), rank).cast("int")
            return F.when(rank == none, state).otherwise(_let(leftmost, at))

        return _let(F.array_min(state), merged)

    last = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(raw) - 1, F.lit(1))), first, step)
    ids = F.transform(F.filter(last, lambda x: x.bitwiseAND(none) != none), lambda x: x.bitwiseAND(none).cast("int"))
    return F.when(F.octet_length(piece).between(1, MAX_FOLD_BYTES), ids)


def _decoder(spark: SparkSession, ranks: RankMap):
    """A task that adds `decoded`, the binary pieces of the ids one after the other, to rows with ids and ids_bytes."""
    by_rank = {rank: piece for piece, rank in ranks.ranks.items()}
    sent = spark.sparkContext.broadcast([by_rank.get(i) for i in range(max(by_rank) + 1)])

    def concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(sent.value, pa.large_binary())
        for batch in batches:
            for part in sub_batches(batch, column="ids_bytes"):
                ids = part.column("ids").fill_null([])
                flat = pieces.take(ids.flatten())
                lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64)]), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).cast(pa.binary())], [*part.schema.names, "decoded"])

    return concatenate


def decode(encoded: DataFrame, ranks: RankMap) -> DataFrame:
    """The rows with `decoded`, the bytes of their token ids."""
    return encoded.mapInArrow(tidy(_decoder(encoded.sparkSession, ranks)), "".join(f"{f.name} {f.dataType.simpleString()}, " for f in encoded.schema) + "decoded binary")


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n steps, for pieces beyond MAX_FOLD_BYTES."""
    n = len(piece)
    end, nxt, prv, live = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not live[i] or end[i] != mid or mid >= n or not live[mid] or end[mid] != stop:
            continue
        end[i], live[mid], nxt[i] = stop, False, nxt[mid]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[nxt[i]]))
        if prv[i] >= 0 and (r := ranks.get(piece[prv[i] : stop])) is not None:
            heapq.heappush(heap, (r, prv[i], i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def piece_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """(piece, n) over all documents; counted in each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                distinct, codes, _ = split(texts_of(part), pattern)
                n = np.bincount(codes, minlength=len(distinct))
                keep = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([distinct.take(pa.array(keep)), pa.array(n[keep])], ["piece", "n"])

    return docs.select("text").mapInArrow(tidy(count), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def _hot(counts: DataFrame, max_hot: int, max_bytes: int = 64) -> DataFrame:
    """The most frequent pieces, max_hot of them (in expectation): all above a count, and of that count a share by hash."""
    short = counts.filter(F.octet_length("piece").between(1, max_bytes))
    # Counts above 1,024 meet in steps of a 64th, so that what comes to the driver is bounded.
    step = F.when(F.col("n") <= 1024, F.col("n")).otherwise(F.ceil(F.log2("n") * 64) + 1024).cast("long")
    many = {r["step"]: r["pieces"] for r in short.groupBy(step.alias("step")).agg(F.count("*").alias("pieces")).collect()}
    total, least, share = 0, 0, 0.0
    for k in sorted(many, reverse=True):
        if total + many[k] > max_hot:
            least, share = k, (max_hot - total) / many[k]
            break
        total += many[k]
    some = F.pmod(F.xxhash64("piece"), F.lit(1 << 20)) < int(share * (1 << 20))
    return short.filter((step > least) | ((step == least) & some))


def encode(docs: DataFrame, ranks: RankMap, pattern: str, max_hot: int = 1 << 19, decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int>, ids_bytes (the ids as little-endian unsigned 32-bit integers) of every document.

    With `decoded`, also the bytes that decode() gives for the ids, by the same worker (a second one would wait beside it).
    """
    spark = docs.sparkSession
    docs = id_text(docs)
    counts = stored(piece_counts(docs, pattern), "pieces")
    hot = _hot(counts, max_hot).select("piece", fold_piece(F.col("piece"), ranks).alias("ids")).toArrow().combine_chunks()
    words, lists = (hot.column(c).combine_chunks() if hot.num_rows else pa.array([], kind) for c, kind in (("piece", pa.string()), ("ids", pa.list_(pa.int32()))))
    n_hot = len(words)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("piece", pa.large_string())])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([words.cast(pa.large_string())], ["piece"]))
    known = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.uint8)  # a piece of at most 64 bytes
    known_ids = spark.sparkContext.broadcast((lengths, lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)))
    rank_file = spark.sparkContext.broadcast(ranks.ranks)
    del hot, words, lists, sink, lengths
    tidy_driver(spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as indices of pieces; the first of a batch carries those that aren't in the broadcast."""
        value_set = pa.ipc.open_stream(pa.py_buffer(known.value)).read_all().column("piece").combine_chunks()
        schema = pa.schema([("doc_id", pa.int64()), ("codes", pa.binary()), ("fresh", pa.list_(pa.string()))])
        for batch in batches:
            if not len(batch):
                continue
            parts, codes, counts_ = [], [], []
            for part in sub_batches(batch):
                distinct, code, offsets = split(texts_of(part), pattern)
                codes.append((code, sum(map(len, parts))))
                parts.append(distinct)
                counts_.append(np.diff(offsets))
            distinct = pa.concat_arrays(parts)
            at = pc.index_in(distinct.cast(pa.large_string()), value_set=value_set)
            cold = distinct.filter(at.is_null()).dictionary_encode()
            index = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            index[index < 0] = cold.indices.to_numpy(zero_copy_only=False) + n_hot
            n = np.concatenate(counts_)
            code = np.concatenate([index[code + base] for code, base in codes]).astype("<u4")
            coded = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n * 4)]).astype(np.int32)), pa.py_buffer(code.tobytes())])
            fresh = pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(len(n) + 1), 1) * len(cold.dictionary), pa.int32()), cold.dictionary)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), coded, fresh], schema=schema)
            del parts, codes, distinct, at, cold, index, code, coded, fresh
            release()  # four workers of an executor hold what a batch needs

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents as ids, by the broadcast and by the pieces that the first document of their batch carries."""
        hot_lengths, hot_flat = known_ids.value
        hot_lengths = hot_lengths.astype(np.int32)
        lengths, flat, starts = hot_lengths, hot_flat, np.cumsum(hot_lengths, dtype=np.int64) - hot_lengths
        for batch in batches:
            carried = pc.list_value_length(batch.column("fresh")).to_numpy(zero_copy_only=False)
            edges = np.unique(np.concatenate([[0], np.flatnonzero(carried), [len(batch)]])).astype(np.int64)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if carried[lo]:
                    col, pieces = batch.column("ids").slice(lo, 1).flatten(), batch.column("fresh").slice(lo, 1).flatten()
                    if col.null_count:  # pieces beyond the fold
                        merged = [heap_merge(p.encode(), rank_file.value) if x is None else x for x, p in zip(col.to_pylist(), pieces.to_pylist(), strict=True)]
                        col = pa.array(merged, pa.list_(pa.int32()))
                    lengths = np.concatenate([hot_lengths, pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int32)])
                    flat = np.concatenate([hot_flat, col.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)])
                    starts = np.cumsum(lengths, dtype=np.int64) - lengths
                part = batch.slice(lo, hi - lo)
                coded = part.column("codes").to_pylist()
                code = np.frombuffer(b"".join(coded), "<u4")
                per_piece = lengths[code]
                ids = flat[ragged(starts[code], per_piece)].astype("<u4")
                ends = np.concatenate([[0], np.cumsum(per_piece, dtype=np.int64)])[np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int64)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(coded), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, raw], ["doc_id", "ids", "ids_bytes"])
                del coded, code, per_piece, ids, lists, raw
            release()

    cut_rows = docs.mapInArrow(tidy(cut), "doc_id long, codes binary, fresh array<string>")
    folded = cut_rows.select("doc_id", "codes", "fresh", fold_pieces(F.col("fresh"), ranks).alias("ids"))
    schema = "doc_id long, ids array<int>, ids_bytes binary"
    if not decoded:
        return folded.mapInArrow(tidy(join), schema)
    back = _decoder(spark, ranks)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return back(join(batches))

    return folded.mapInArrow(tidy(both), schema + ", decoded binary")
