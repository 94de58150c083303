"""Conversation prefix trie (operator 12): which conversations share how many first turns, and what sharing them saves.

A turn is known by two 64-bit digests of its role and text, a prefix of turns by two polynomial sums of those (modulo 2**64),
so a prefix is a row, and never an array of turns. Sums run along globally sorted turns: each task sums its own stretch, and
the few conversations that cross from one task's stretch into the next get the sums before it added. Nodes are the distinct
prefixes, grouped with partial aggregation.

Subtrees: nodes with more members than `heavy` are the upper levels. Below them each prefix is a shard of its own; a task lays
the shards it holds out in level order as LOUDS bits with label arrays, finds parents by rank and select, and rolls leaves and
savings up by add.at, deepest level first. The sums of each shard's top are added up by parent, and the upper levels, at most
2**20 nodes (`heavy` grows with the table for that), are laid out and rolled up the same way. Where a conversation is alone,
from some turn on, its nodes need no trie: they are written from its rows.

Null roles and texts count as empty; turns without a number come first, ties go by digest; repeated rows are turns of their
own; rows without a conv_id are left out; extra columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Bits
from .common import BASE, BASE_INV, mix64, ship, stored, tidy

#: Most turns that a rebuilt conversation takes over, and how many neighbours share a first one.
TAKEN, SIBLINGS = 8, 5
#: Members up to which a prefix is a shard of its own, in tables of up to this times 2**20 rows.
HEAVY = 1024
#: Nodes laid out at once, unless one shard has more.
LAYOUT_NODES = 1 << 18
_M = (1 << 64) - 1
#: Second multiplier; odd like the first, so both have inverses.
BASE_2 = 0xD6E8FEB86659FD93
BASE_2_INV = pow(BASE_2, -1, 1 << 64)
KEY = ["depth", "p1", "p2"]


def _power(base: int, inverse: int, exponents: np.ndarray) -> np.ndarray:
    """base**k modulo 2**64, for negative k too, by squaring."""
    out, k = np.ones(len(exponents), np.uint64), np.abs(exponents).astype(np.uint64)
    step = np.where(exponents < 0, np.uint64(inverse), np.uint64(base))
    while k.any():
        out = np.where(k & np.uint64(1), out * step, out)
        step, k = step * step, k >> np.uint64(1)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _sorted(turns: DataFrame, parts: int) -> DataFrame:
    """Turns in order, each with the number of the task's stretch that holds it and the sums' terms and totals since the stretch began."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, sums = None, 0, (0, 0)
        for batch in batches:
            if not len(batch):
                continue
            conv = _column(batch, "conv_id")
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(conv))))
            goes_on = (own == 0) & (conv[0] == last)
            k = np.arange(1, len(conv) + 1) - first[own] + np.where(goes_on, count, 0)
            out = []
            for name, base, inverse, before in (("l1", BASE, BASE_INV, sums[0]), ("l2", BASE_2, BASE_2_INV, sums[1])):
                term = mix64(_column(batch, name).view(np.uint64)) * _power(base, inverse, k)
                total = np.cumsum(term, dtype=np.uint64)
                total -= np.concatenate([[np.uint64(0)], total])[first][own]
                total += np.where(goes_on, np.uint64(before), np.uint64(0))
                out += [term, total]
            last, count, sums = conv[-1], int(k[-1]), (int(out[1][-1]), int(out[3][-1]))
            yield pa.RecordBatch.from_arrays([batch.column("stretch"), batch.column("conv_id"), pa.array(k.astype(np.int64)), *map(_signed, out), batch.column("bytes")], ["stretch", "conv_id", "k", "t1", "s1", "t2", "s2", "bytes"])

    order = ["conv_id", "turn", "l1", "l2"]
    spread = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("stretch", F.spark_partition_id().cast("long"))
    return spread.mapInArrow(scan, "stretch long, conv_id long, k long, t1 long, s1 long, t2 long, s2 long, bytes long")


def _before(scanned: DataFrame) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(stretch, conversation) -> turns and sums before it, for those that go on from an earlier stretch: at most one a stretch."""
    edges = scanned.groupBy("stretch").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).collect()  # a row a stretch
    edges.sort(key=lambda r: r["stretch"])
    over = {b["lo"] for a, b in zip(edges, edges[1:], strict=False) if a["hi"] == b["lo"]}
    if not over:
        return {}
    tops = scanned.filter(F.col("conv_id").isin(sorted(over))).groupBy("conv_id", "stretch").agg(F.max_by(F.struct("k", "s1", "s2"), "k").alias("top"))
    found, sums = {}, {}
    for r in sorted(tops.collect(), key=lambda r: (r["conv_id"], r["stretch"])):
        n, a, b = found[r["stretch"], r["conv_id"]] = sums.get(r["conv_id"], (0, 0, 0))
        top = r["top"]
        sums[r["conv_id"]] = (n + top["k"], (a + top["s1"] * pow(BASE, n, 1 << 64)) & _M, (b + top["s2"] * pow(BASE_2, n, 1 << 64)) & _M)
    return found


def _placed(scanned: DataFrame) -> DataFrame:
    """conv_id, k, bytes, and both sums of the first k turns (a1, a2) and of those before the k-th (b1, b2)."""
    before = _before(scanned)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, stretch, k = (_column(batch, c) for c in ("conv_id", "stretch", "k"))
            cols = {c: _column(batch, c).view(np.uint64) for c in ("t1", "s1", "t2", "s2")}
            n, add = np.zeros(len(conv), np.int64), {"1": np.zeros(len(conv), np.uint64), "2": np.zeros(len(conv), np.uint64)}
            for s, c in {(s, c) for s, c in before if (stretch == s).any()}:
                mine = (stretch == s) & (conv == c)
                n[mine], add["1"][mine], add["2"][mine] = before[s, c]
            out = []
            for i, base, inverse in (("1", BASE, BASE_INV), ("2", BASE_2, BASE_2_INV)):
                scale = _power(base, inverse, n)
                total = add[i] + scale * cols[f"s{i}"]
                out += [_signed(total), _signed(total - scale * cols[f"t{i}"])]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(k + n), batch.column("bytes"), *out], ["conv_id", "k", "bytes", "a1", "b1", "a2", "b2"])

    return scanned.mapInArrow(place, "conv_id long, k long, bytes long, a1 long, b1 long, a2 long, b2 long")


_PREFIX = "conv_id long, depth long, p1 long, p2 long, q1 long, q2 long, bytes long, at_end boolean"


def _rebuilt(placed: DataFrame) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: its depth and sums, those of the prefix before it, the bytes of its last text."""
    head = F.when(F.col("k") <= TAKEN, F.struct("k", "a1", "a2", "b1", "b2", "bytes"))
    convs = stored(placed.groupBy("conv_id").agg(F.max("k").alias("n"), F.array_sort(F.collect_list(head)).alias("first")), "conversations")
    takes = (F.crc32(F.col("conv_id").cast("string")) % (TAKEN + 1)).alias("h")
    own = convs.select("conv_id", "n", "first", takes, (F.col("conv_id") - F.col("conv_id") % SIBLINGS).alias("base"))
    given = convs.select(F.col("conv_id").alias("base"), F.col("first").alias("given"))
    sized = own.join(given, "base", "left").withColumn("took", F.least("h", F.coalesce(F.size("given"), F.lit(0))).cast("long"))
    skipped = F.least("h", "n").cast("int")
    at = lambda array, k, name: F.coalesce(F.get(array, F.col(k).cast("int") - 1)[name], F.lit(0).cast("long"))
    plan = stored(
        sized.withColumn("skipped", skipped).select(
            "conv_id", "h", "took", (F.col("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), F.slice(F.coalesce("given", F.array().cast("array<struct<k:long,a1:long,a2:long,b1:long,b2:long,bytes:long>>")), F.lit(1), F.col("took").cast("int")).alias("given"),
            *(at("given", "took", c).alias(f"g{c}") for c in ("a1", "a2")), *(at("first", "skipped", c).alias(f"o{c}") for c in ("a1", "a2")),
        ), "plan",
    )
    zero = F.lit(0).cast("long")
    roots = plan.select("conv_id", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("q1"), zero.alias("q2"), zero.alias("bytes"), (F.col("length") == 0).alias("at_end"))
    taken = plan.select("conv_id", "length", F.explode("given").alias("t")).select("conv_id", F.col("t.k").alias("depth"), F.col("t.a1").alias("p1"), F.col("t.a2").alias("p2"), F.col("t.b1").alias("q1"), F.col("t.b2").alias("q2"), F.col("t.bytes").alias("bytes"), (F.col("t.k") == F.col("length")).alias("at_end"))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved, depth = _column(batch, "took") - _column(batch, "h"), _column(batch, "took") + _column(batch, "k") - _column(batch, "h")
            out = {}
            for i, base, inverse in (("1", BASE, BASE_INV), ("2", BASE_2, BASE_2_INV)):
                given, own, scale = _column(batch, f"ga{i}").view(np.uint64), _column(batch, f"oa{i}").view(np.uint64), _power(base, inverse, moved)
                for to, of in (("p", "a"), ("q", "b")):
                    out[to + i] = _signed(given + scale * (_column(batch, f"{of}{i}").view(np.uint64) - own))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth), out["p1"], out["p2"], out["q1"], out["q2"], batch.column("bytes"), pa.array(depth == _column(batch, "length"))], [c.split()[0] for c in _PREFIX.split(", ")])

    rest = placed.join(plan.drop("given"), "conv_id").filter("k > h").mapInArrow(shift, _PREFIX)
    return roots.unionByName(taken).unionByName(rest)


def layout(depth: np.ndarray, p1: np.ndarray, p2: np.ndarray, q1: np.ndarray, q2: np.ndarray) -> tuple[np.ndarray, np.ndarray, Bits]:
    """Nodes of a forest in level order (depths from 0, tops first), the bounds of the levels, and the LOUDS bits: for a root above the tops and for each node as many ones as it has children, then a zero."""
    order, bounds, degrees = [], [0], [np.array([np.count_nonzero(depth == 0)], np.int64)]
    by_depth = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=-1)) + 2))
    above = None
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        own = by_depth[start:end]
        if above is not None:
            lookup = np.lexsort((p2[above], p1[above]))
            s1, s2 = p1[above][lookup], p2[above][lookup]
            at = np.searchsorted(s1, q1[own])
            while (wrong := s2[at] != q2[own]).any():
                at += wrong
            parent = lookup[at]
            own = own[np.argsort(parent, kind="stable")]
            degrees.append(np.bincount(parent, minlength=len(above)))
        order.append(own)
        bounds.append(end)
        above = own
    if above is not None:
        degrees.append(np.zeros(len(above), np.int64))
    counts = np.concatenate(degrees)
    ends = np.cumsum(counts + 1)
    ones = np.ones(int(ends[-1]), bool)
    ones[ends - 1] = False
    return np.concatenate([*order, np.zeros(0, np.int64)]), np.array(bounds), Bits.at(np.flatnonzero(ones), len(ones))


def rolled(nodes: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Children, leaves, savings and the parent's conversation (-1 and no parent at a top) of each node of a forest."""
    order, bounds, louds = layout(*(nodes[c] for c in ("level", "p1", "p2", "q1", "q2")))
    n = len(order)
    ones = louds.select()
    # The i-th one stands for node i in its parent's run; zeros before it close the runs of the nodes before that parent.
    parent = ones - np.arange(n) - 1
    zeros = np.delete(np.arange(2 * n + 1), ones)
    degree = np.diff(zeros)[:n] - 1 if n else np.zeros(0, np.int64)
    own = {k: nodes[k][order] for k in ("n_convs", "bytes", "conv_id", "add_children", "add_leaves", "add_saved")}
    children = degree + own["add_children"]
    leaves = np.where(children == 0, 1, own["add_leaves"])
    saved = (own["n_convs"] - 1) * own["bytes"] + own["add_saved"]
    for start, end in zip(bounds[-2:0:-1], bounds[:1:-1], strict=True):
        np.add.at(leaves, parent[start:end], leaves[start:end])
        np.add.at(saved, parent[start:end], saved[start:end])
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    top = parent < 0
    return {"n_children": children[back], "n_leaves": leaves[back], "saved_tokens": saved[back], "top": top[back], "parent_conv_id": np.where(top, 0, own["conv_id"][np.maximum(parent, 0)])[back] if n else parent}


_INPUT = ["conv_id", *KEY, "q1", "q2", "n_convs", "bytes", "add_children", "add_leaves", "add_saved"]
_ROLLED = "conv_id long, depth long, p1 long, p2 long, q1 long, q2 long, n_convs long, top boolean, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def _laid_out(nodes: DataFrame, shard: list[str]) -> DataFrame:
    """rolled() over whole shards, some at a time; rows of a shard come together, and `shard` starts with the depth of its tops."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        given = {c: _column(batch, c) for c in _INPUT}
        out = rolled(given | {"level": given["depth"] - _column(batch, shard[0])})
        names = [c.split()[0] for c in _ROLLED.split(", ")]
        made = out | {"parent_conv_id": pa.array(out["parent_conv_id"], mask=out["top"])}
        return pa.RecordBatch.from_arrays([pa.array(made[c]) if c in made else batch.column(c) for c in names], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            if size >= LAYOUT_NODES:
                # The last shard may go on in the next batch; what stands before it is whole.
                whole = pa.Table.from_batches(have).combine_chunks().to_batches()[0]
                new = np.zeros(len(whole), bool)
                for c in shard:
                    new[1:] |= _column(whole, c)[1:] != _column(whole, c)[:-1]
                at = int(np.flatnonzero(new)[-1]) if new.any() else 0
                if at:
                    yield flush([whole.slice(0, at)])
                have = [whole.slice(at)]
                size = len(whole) - at
            have.append(batch)
            size += len(batch)
        if have:
            yield flush(have)

    return nodes.select(*_INPUT, *(c for c in shard if c not in _INPUT)).mapInArrow(tidy(work), _ROLLED)


def _ends(members: DataFrame, parts: int) -> DataFrame:
    """depth, p1, p2, ends_sha256: the digest of the ids in order. Ids are joined where they are sorted; the digest runs over the joined texts."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([_column(batch, c) for c in KEY])
            starts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
            conv = _column(batch, "conv_id")
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(conv)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(key[i, starts]) for i in range(3)), pa.array(conv[starts]), pa.array(texts)], [*KEY, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[c] for c in KEY)
                if key == last:
                    sha.update(f",{row['ids']}".encode())
                    continue
                if last is not None:
                    out.append((*last, sha.hexdigest()))
                last, sha = key, hashlib.sha256(row["ids"].encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "ends_sha256"])
                out = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*last, sha.hexdigest())], [*KEY, "ends_sha256"])

    order = [*KEY, "conv_id"]
    joined = members.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(join, "depth long, p1 long, p2 long, first long, ids string")
    return joined.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth long, p1 long, p2 long, ends_sha256 string")


def build(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("l1"), F.xxhash64(text, F.lit("turn"), role).alias("l2"), F.octet_length(text).cast("long").alias("bytes")).filter("conv_id is not null")
    prefixes = stored(_rebuilt(stored(_placed(stored(_sorted(turns, parts), "sorted-turns")), "placed-turns")), "prefixes")
    nodes = stored(prefixes.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2")), "nodes")
    heavy = max(heavy, prefixes.count() >> 20)
    upper = nodes.filter((F.col("depth") == 0) | (F.col("n_convs") > heavy))  # at most 2**20 and the root
    none = F.lit(0).cast("long")
    nothing = F.sha2(F.lit("").cast("binary"), 256)

    # Where a conversation is alone.
    alone = nodes.filter("depth > 0 and n_convs = 1")
    tails = stored(alone.groupBy("conv_id").agg(F.min("depth").alias("since"), F.max("depth").alias("until")), "tails")
    singles = alone.join(tails, "conv_id")
    one = F.lit(1).cast("long")
    own_id = F.sha2(F.col("conv_id").cast("string"), 256)
    below = singles.filter("depth > since").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("until")).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("depth") == F.col("until"), own_id).otherwise(nothing).alias("ends_sha256"))

    # Shards: each node below the upper levels goes to its first prefix below them.
    highest = prefixes.join(F.broadcast(upper.select(*KEY)), KEY).groupBy("conv_id").agg((F.max("depth") + 1).alias("cut"))
    cuts = prefixes.join(highest, "conv_id").filter("depth = cut").select("conv_id", "cut", F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    lower = nodes.filter((F.col("depth") > 0) & (F.col("n_convs") <= heavy) & (F.col("n_convs") > 1)).select(*_INPUT[:8], *(none.alias(c) for c in _INPUT[8:]))
    first_alone = singles.filter("depth = since").select(*_INPUT[:8], (F.col("until") > F.col("since")).cast("long").alias("add_children"), one.alias("add_leaves"), none.alias("add_saved"))
    shard = ["cut", "k1", "k2"]
    dealt = lower.unionByName(first_alone).join(cuts, "conv_id").repartition(parts, *shard).sortWithinPartitions(*shard, "depth")
    lower_done = stored(_laid_out(dealt, shard), "lower-levels")

    tops = lower_done.filter("top")
    sums = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("add_children"), F.sum("n_leaves").alias("add_leaves"), F.sum("saved_tokens").alias("add_saved"))
    upper_in = upper.join(sums, KEY, "left").fillna(0, ["add_children", "add_leaves", "add_saved"]).withColumn("cut", none)
    upper_done = _laid_out(upper_in.repartition(1), ["cut"])
    parents = F.broadcast(upper.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("of")))
    linked = tops.join(parents, ["depth", "q1", "q2"]).withColumn("parent_conv_id", F.col("of")).drop("of")
    ends = _ends(prefixes.filter("at_end").join(tails, "conv_id", "left_anti"), parts)
    done = lower_done.filter("not top").unionByName(linked).unionByName(upper_done).join(ends, KEY, "left")
    sha = F.coalesce("ends_sha256", F.when((F.col("n_convs") == 1) & (F.col("depth") > 0) & (F.col("n_children") == 0), own_id), nothing)
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256")).unionByName(below)
