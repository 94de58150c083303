"""Language-model scores by an Elias-Fano trie of word trigrams (operator 13).

Tokens are lower-cased words and an end; two starts stand before a text. The model interpolates three levels, each a proper
distribution over the training words, the end and one unknown word:

    p1(w)        = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p2(w | v)    = (c(v w) + M p1(w)) / (c(v) + M)
    p3(w | u, v) = max(c(u v w) - D, 0) / c(u v) + D t(u v) / c(u v) * p2(w | v)      t: distinct words after u v

with p2 alone after a context that training hasn't. Counts are of all training rows.

Spark does it in blocks of documents (blocks.py): each block sends its distinct words and gets their counts and ids (more
frequent words of a part get smaller ones) back; then it sends its distinct trigrams with its training counts, dealt by a hash
of the context (u, v), so that a frequent word's contexts spread over all shards. A shard's task adds up the counts of all
blocks, builds the trie of its trained n-grams, asks it for each distinct n-gram that any block holds, and answers the blocks.

The trie (Trie): level 1 has u's, level 2 the v's of each u, level 3 the w's of each u v. A level is one Elias-Fano sequence
of numbers relative to their context: each context gets a stretch as long as its largest word id, and the monotone pointers
to those stretches are Elias-Fano too. A query finds its context's stretch and then the successor in it. Logarithms of
the counts, of the weight that goes to the lower level and of the discounted shares are 16-bit steps of 1/4096. All arrays lie
in one memory map, which is closed with its shard.

Nulls and empty texts have the end alone; rows for which `learn` is null or false are only scored; a null doc_id is kept;
repeated rows count and are scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import answered, asked, block_ids, by_part, dealt, gathered, in_order, pack, pack_values, runs_of, unpack, unpack_values
from .common import id_text, lower_ascii, mix64, prefix_hash, ragged, span_hash, stored, sub_batches, tidy, utf8, words_of
from .elias_fano import EliasFano

#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
#: Added to each word's count; discount of trigrams; weight of the words alone against a context.
ADDED, DISCOUNT, PRIOR = 0.1, 0.75, 200.0
STEPS = 4096
#: The end's key, below all hashes of words, and the id that stands for a start (and for what follows the end).
END, START = 0, 0


def to_steps(logs: np.ndarray, offset: float) -> np.ndarray:
    """log10 values from -offset on as 16-bit steps from 1 on; 0 is kept for "none"."""
    return np.clip(np.rint((logs + offset) * STEPS) + 1, 1, 65535).astype(np.uint16)


def from_steps(steps: np.ndarray, offset: float) -> np.ndarray:
    return 10.0 ** ((steps.astype(np.float64) - 1) / STEPS - offset)


class Trie:
    """N-grams of one shard: `find` gives the steps of a context's count and lower weight, and of a trigram's share."""

    def __init__(self, arrays: list[np.ndarray]):
        size = sum(a.nbytes + 8 for a in arrays)
        self.map = mmap.mmap(-1, max(size, 1))
        at, laid = 0, []
        for a in arrays:
            view = np.frombuffer(self.map, a.dtype, len(a), at)
            view[:] = a
            laid.append(view)
            at += (a.nbytes + 7) // 8 * 8
        self.firsts, self.seconds, self.thirds, self.base_2, self.base_3 = (EliasFano.from_arrays(*laid[i : i + 4]) for i in range(0, 20, 4))
        self.count, self.lower, self.share = laid[20:]

    @classmethod
    def of(cls, u: np.ndarray, v: np.ndarray, of_context: np.ndarray, w: np.ndarray, c: np.ndarray) -> Trie:
        """From contexts (ascending), and trained trigrams as the context's index, word and count (ascending)."""
        firsts, start = np.unique(u, return_index=True)
        of_first = np.repeat(np.arange(len(firsts)), np.diff(np.append(start, len(u))))
        levels = []
        for group, value, n in ((of_first, v, len(firsts)), (of_context, w, len(u))):
            longest = np.zeros(n, np.uint64)
            np.maximum.at(longest, group, value + np.uint64(1))
            base = np.concatenate([[np.uint64(0)], np.cumsum(longest, dtype=np.uint64)])
            levels.append((EliasFano.of(base[group] + value), EliasFano.of(base)))
        total = np.bincount(of_context, c, len(u))
        kinds = np.bincount(of_context, minlength=len(u))
        values = [to_steps(np.log10(total), 0), to_steps(np.log10(DISCOUNT * kinds / total), 15), to_steps(np.log10((c - DISCOUNT) / total[of_context]), 15)]
        (seconds, base_2), (thirds, base_3) = levels
        return cls([a for s in (EliasFano.of(firsts), seconds, thirds, base_2, base_3) for a in s.arrays()] + values)

    @staticmethod
    def _within(base: EliasFano, level: EliasFano, context: np.ndarray, value: np.ndarray, each: np.ndarray | None = None) -> np.ndarray:
        """Index in a level of each value in its context's stretch, or -1; `each`: values a context, where they differ from one."""
        known = np.flatnonzero(context >= 0)
        begin, end = np.zeros(len(context), np.uint64), np.zeros(len(context), np.uint64)
        begin[known], end[known] = base.access(context[known]), base.access(context[known] + 1)
        if each is not None:
            begin, end = np.repeat(begin, each), np.repeat(end, each)
        out = np.full(len(value), -1, np.int64)
        inside = np.flatnonzero(value < end - begin)
        out[inside] = level.find(begin[inside] + value[inside])
        return out

    def find(self, u: np.ndarray, v: np.ndarray, each: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of contexts (u, v), each followed by `each` of the words w: steps of count, lower weight and share; 0 where not trained."""
        distinct, where = np.unique(u, return_inverse=True)
        context = self._within(self.base_2, self.seconds, self.firsts.find(distinct)[where], v)
        share = self._within(self.base_3, self.thirds, context, w, each)
        value = lambda steps, index: np.where(index >= 0, np.append(steps, np.uint16(0))[index], np.uint16(0))
        return value(self.count, context), value(self.lower, context), value(self.share, share)


_BLOCK = "block long, doc_id array<long>, learned array<boolean>, lengths binary, codes binary, places binary, keys binary, sums binary"


def _blocks(docs: DataFrame, parts: int) -> DataFrame:
    """One row a block: its distinct words (hashes, the end first, then frequent ones first) with their training counts and parts, and its tokens as indices into those."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_ids()
        for batch in gathered(batches, BLOCK_BYTES):
            for part in sub_batches(batch, BLOCK_BYTES):
                buf, offsets = utf8(part)
                buf = lower_ascii(buf)
                starts, ends, at = words_of(buf, offsets)
                hashes = span_hash(prefix_hash(buf), starts, ends)
                lengths = np.diff(at) + 1
                tokens = np.full(len(hashes) + len(lengths), END, np.uint64)
                tokens[np.arange(len(hashes)) + np.repeat(np.arange(len(lengths)), lengths - 1)] = hashes
                keys, codes, times = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.concatenate([[0], 1 + np.argsort(-times[1:], kind="stable")])
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                keys, codes = keys[order], rank[codes]
                learned = part.column("learned").fill_null(False)
                trained = np.repeat(learned.to_numpy(zero_copy_only=False).astype(bool), lengths)
                sums = np.bincount(codes[trained], minlength=len(keys))
                cells = [[next(numbers)], [part.column("doc_id").to_pylist()], [learned.to_pylist()], [pack(lengths)], [pack(codes)], [pack(dealt(keys, parts))], [pack(keys)], [pack(sums)]]
                types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

    return docs.mapInArrow(tidy(work), _BLOCK)


def _numbered(parts: int):
    def answer(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
        """Counts, and ids from 1 on: frequent words first, parts taking turns."""
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((keys, -sums))] = np.arange(len(keys))
        return sums, rank * parts + dealt(keys, parts) + 1

    return answer


def _ordered(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by columns, the first one first."""
    bits = [int(c.max(initial=0)).bit_length() for c in columns]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.int64)
    for c, b in zip(columns, bits, strict=True):
        key = key << b | c.astype(np.int64)
    return np.argsort(key)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _stepped(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Numbers that ascend within each group as differences from the one before."""
    out = values.copy()
    same = group[1:] == group[:-1]
    out[1:][same] -= values[:-1][same]
    return out


def _summed(steps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The numbers of _stepped()."""
    total = np.cumsum(steps, dtype=np.uint64)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    return total - np.repeat(total[first] - steps[first], np.diff(np.append(first, len(group))))


class Positions:
    """The tokens of a block, each with its two predecessors, and one position more after each end (its context is the last pair)."""

    def __init__(self, row: dict, parts: int):
        self.lengths = unpack(row["lengths"]).astype(np.int64)
        self.count, ids = in_order(row["answers"], unpack(row["places"]).astype(np.int64), 2)
        codes = unpack(row["codes"]).astype(np.int64)
        n = self.lengths + 1
        begin = np.cumsum(n) - n
        self.token = np.ones(int(n.sum()), bool)
        self.token[begin + n - 1] = False
        self.doc = np.repeat(np.arange(len(n)), n)
        # Words by rank of id, so that three of them fit into one number; 0: start, and what follows the end.
        by_id = np.argsort(ids)
        self.ids = np.concatenate([[np.uint64(START)], ids[by_id]])
        self.counts = np.concatenate([[np.uint64(0)], self.count[by_id]])
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(1, len(ids) + 1)
        self.w = np.zeros(len(self.token), np.int64)
        self.w[self.token] = rank[codes]
        self.v, self.u = np.zeros_like(self.w), np.zeros_like(self.w)
        self.v[1:], self.u[2:] = self.w[:-1], self.w[:-2]
        self.v[begin] = self.u[begin] = 0
        self.u[np.minimum(begin + 1, len(self.u) - 1)] = 0
        order = _ordered(self.u, self.v, self.w)
        u, v, w = self.u[order], self.v[order], self.w[order]
        new = _changes(u, v, w)
        self.trigram = np.empty(len(order), np.int64)
        self.trigram[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        learned = np.array(row["learned"], bool)[self.doc]
        self.trained = np.add.reduceat(learned[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
        context = _changes(u[new], v[new])
        self.each = np.diff(np.append(context, len(new)))
        self.of_context = np.repeat(np.arange(len(context)), self.each)
        self.cu, self.cv, self.cw = self.ids[u[new][context]], self.ids[v[new][context]], self.ids[w[new]]
        # Contexts by shard, and the trigrams under them in the same order.
        self.contexts, self.bounds = by_part(dealt(mix64(self.cu) + self.cv, parts), parts)
        self.trigrams = ragged(context[self.contexts], self.each[self.contexts])


def _requests(blocks: DataFrame, parts: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = Positions(row, parts)
                under = np.concatenate([[0], np.cumsum(p.each[p.contexts])])[p.bounds]
                for s in range(parts):
                    own, below = p.contexts[p.bounds[s] : p.bounds[s + 1]], p.trigrams[under[s] : under[s + 1]]
                    if len(own):
                        cells = [s, row["block"], pack(p.cu[own], True), pack(_stepped(p.cv[own], p.cu[own])), pack(p.each[own]), pack(_stepped(p.cw[below], np.repeat(own, p.each[own]))), pack(p.trained[below])]
                        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, (pa.int32(), pa.int64(), *[pa.binary()] * 5), strict=True)], ["part", "block", "u", "v", "each", "w", "n"])

    return blocks.mapInArrow(tidy(work), "part int, block long, u binary, v binary, each binary, w binary, n binary")


def _replies(requests: DataFrame, parts: int) -> DataFrame:
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in runs_of(batches, "part"):
            u, v, each, w, n = ([unpack(r.pop(c)) for r in rows] for c in ("u", "v", "each", "w", "n"))
            v = [_summed(x, g) for x, g in zip(v, u, strict=True)]
            w = [_summed(x, np.repeat(np.arange(len(e)), e.astype(np.int64))) for x, e in zip(w, each, strict=True)]
            sizes, under = [len(x) for x in u], [len(x) for x in w]
            u, v, w, n = (np.concatenate(x) for x in (u, v, w, n))
            each = np.concatenate(each).astype(np.int64)
            order = _ordered(u, v)
            new = _changes(u[order], v[order])
            context = np.empty(len(u), np.int64)
            context[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
            u, v = u[order[new]], v[order[new]]
            above = np.repeat(context, each)
            order = _ordered(above, w)
            new = _changes(above[order], w[order])
            trigram = np.empty(len(w), np.int64)
            trigram[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
            c = np.add.reduceat(n[order].astype(np.int64), new)
            above, w = above[order[new]], w[order[new]]
            del order, new, n
            held = c > 0
            index = np.cumsum(np.bincount(above[held], minlength=len(u)) > 0) - 1
            trained = np.flatnonzero(np.bincount(above[held], minlength=len(u)))
            trie = Trie.of(u[trained], v[trained], index[above[held]], w[held], c[held])
            count, lower, share = trie.find(u, v, np.bincount(above, minlength=len(u)), w)
            del trie
            at, below = np.cumsum([0, *sizes]), np.cumsum([0, *under])
            for i, row in enumerate(rows):
                own, its = context[at[i] : at[i + 1]], trigram[below[i] : below[i + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([part], pa.int32()), *(pa.array([pack_values(x)], pa.list_(pa.binary())) for x in (count[own] | lower[own].astype(np.uint32) << np.uint32(16), share[its]))], ["block", "part", "context", "share"])

    dealt_rows = requests.repartition(parts, "part").sortWithinPartitions("part", "block")
    return dealt_rows.mapInArrow(tidy(answer), "block long, part int, context array<binary>, share array<binary>")


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows that `learn` marks."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(_blocks(id_text(docs, learn.alias("learned")), parts), "tokens")
    counted = stored(asked(blocks, parts, dealt, _numbered(parts), lambda keys, sums: [int(sums.sum()), int((sums > 0).sum())]), "word-counts")
    total, distinct = counted.agg(F.coalesce(F.sum(F.get("figures", F.lit(0))), F.lit(0)), F.coalesce(F.sum(F.get("figures", F.lit(1))), F.lit(0))).first()
    known = answered(blocks.drop("keys", "sums"), counted)
    shards = 2 * parts  # n-grams are several times the words that `parts` is meant for
    replies = _replies(_requests(known, shards), shards)
    own = replies.groupBy("block").agg(F.collect_list(F.struct("part", "context", "share")).alias("grams"))
    whole = total + ADDED * (distinct + 1)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p = Positions(row, shards)
                given = sorted(row["grams"], key=lambda g: g["part"])
                both, share = np.zeros(len(p.cu), np.uint32), np.zeros(len(p.cw), np.uint16)
                both[p.contexts] = np.concatenate([unpack_values(g["context"]) for g in given])
                share[p.trigrams] = np.concatenate([unpack_values(g["share"]) for g in given])
                count, lower = both & np.uint32(0xFFFF), both >> np.uint32(16)
                context = p.of_context[p.trigram]
                here = np.flatnonzero(p.token)
                words = p.counts.astype(np.float64)
                single = (words + ADDED) / whole
                # A start is followed as often as texts end.
                words[START] = p.count[END]
                w, v = p.w[here], p.v[here]
                pair = np.where(count > 0, from_steps(count, 0), 0.0)[context[here + 1]]
                second = (pair + PRIOR * single[w]) / (words[v] + PRIOR)
                part_of = np.where(lower > 0, from_steps(lower, 15), 1.0)[context[here]]
                third = np.where(share > 0, from_steps(share, 15), 0.0)[p.trigram[here]] + part_of * second
                docs_of, n = p.doc[here], len(p.lengths)
                columns = {
                    "doc_id": pa.array(row["doc_id"], pa.int64()), "n_tokens": pa.array(p.lengths), "n_known": pa.array(np.bincount(docs_of, p.counts[w] > 0, n).astype(np.int64)),
                    "train_tokens": pa.array(np.full(n, total, np.int64)), "base_score": pa.array(np.bincount(docs_of, np.log10(single)[w], n)), "score": pa.array(np.bincount(docs_of, np.log10(third), n)),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    ready = known.join(own, "block")
    return ready.mapInArrow(tidy(finish), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
