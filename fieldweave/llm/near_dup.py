"""MinHash near-duplicates (operator 6) by an inverted join of signature coordinates.

Each distinct shingle set has a signature of COORDINATES values. A link needs MATCHES equal coordinates (below, a pair at
the similarity threshold falls with a chance of about 3 in a million), so two linked signatures meet under one of the first
COORDINATES - MATCHES + 1 coordinate-value pairs in any common order. Pairs are ordered from rare to frequent by their exact
counts; a pair of one text posts nothing, so a text that shares fewer than MATCHES pairs drops out, and of the others only the
rarest shared pairs that complete the prefix are posted: values that very many texts share are skipped.

A posting is not expanded into pairs. Each member is first held against the smallest text among its postings' smallest ones;
components follow. Postings that still have members in several components (of those with the same members, one) are merged
in place: each member outside the component of the posting's smallest text counts its collisions with the members of other
components, coordinate block by coordinate block, skipping those that can no longer reach MATCHES; who does is confirmed on
full shingle sets, and joins the components at once, so that a posting of n members yields fewer than n links. A posting of
many members is cut into tiles of bounded size.

Null and empty texts link to nothing and are kept; a null doc_id has a null component; rows with equal doc_id share their
component, whatever their texts; ties go to the smaller doc_id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, mix64, ragged, release, stored, sub_batches, tidy
from .graph import components, only_held
from .shingles import shingle_sets

COORDINATES = 64
MATCHES = 36
#: Members and bytes of shingles of a tile's side on average, and bytes that one bucket of postings gets on average.
TILE_MEMBERS = 4096
TILE_BYTES = 8 << 20
BUCKET_BYTES = 1 << 20


def _salts() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:COORDINATES] | np.uint64(1), seeds[COORDINATES:]


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), signature (32-bit values)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = _salts()
        for batch in batches:
            for part in sub_batches(batch):
                sets = shingle_sets(part, words)
                sizes = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(sizes)
                out: list[bytes | None] = [None] * len(sets)
                keys: list[bytes | None] = [None] * len(sets)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum(sizes[full]) - sizes[full]
                    values = np.empty((len(full), COORDINATES), "<u4")
                    for k in range(COORDINATES):
                        values[:, k] = np.minimum.reduceat(flat * times[k] + plus[k], starts) >> np.uint64(32)
                    for row, i in enumerate(full):
                        out[i] = values[row].tobytes()
                        keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.mapInArrow(tidy(sign), "doc_id long, n_shingles long, set_key binary, signature binary")


def _pairs_of(signature: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs as one long each."""
    return mix64(signature.astype(np.uint64) | (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)))


def _postings(signed: DataFrame) -> DataFrame:
    """(pair, doc, size): of each signature, the rarest coordinate-value pairs among which any link shows, if other texts have them."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                pairs = _pairs_of(np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES))
                docs = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64).ravel()), pa.array(docs)], ["pair", "doc"])

    every = signed.select("doc_id", "signature").mapInArrow(tidy(post), "pair long, doc long")
    # A table of its own: with its aggregation in the join's stage, a frequent pair could not be split.
    several = stored(every.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1"), "pairs")
    ranked = every.join(several, "pair").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("ranked"))  # at most COORDINATES
    prefix = F.slice("ranked", F.lit(1), F.size("ranked") - F.lit(MATCHES - 1))
    posted = ranked.filter(F.size("ranked") >= MATCHES).select(F.explode(prefix["pair"]).alias("pair"), "doc")
    return posted.join(signed.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("size")), "doc")


def _sets(ends: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(doc, shingles): the sorted 64-bit shingles of the texts of `ends` (doc_id)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in shingle_sets(part, words)], pa.large_binary())], ["doc", "shingles"])

    ends = ends.distinct()
    texts = only_held(docs, ends).join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stored(texts.mapInArrow(tidy(cut), "doc long, shingles binary"), "sets")


def _confirmed(candidates: DataFrame, signed: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The candidates (a, b) whose signatures match and whose shingle sets are similar enough."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, COORDINATES) for c in ("sa", "sb"))
            keep = pa.array((x == y).sum(1) >= MATCHES)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, column="xb"):
                keep = []
                for xa, xb in zip(part.column("xa"), part.column("xb"), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (xa, xb))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    sig = signed.select("doc_id", "signature")
    near = candidates.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").mapInArrow(tidy(matched), "a long, b long")
    near = stored(near, "matched")
    sets = _sets(near.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, words)
    wide = near.join(sets.toDF("b", "xb"), "b").join(sets.toDF("a", "xa"), "a").select("a", "b", "xa", "xb")
    return wide.mapInArrow(tidy(similar), "a long, b long")


def merge_posting(signature: np.ndarray, sets: list[np.ndarray], component: np.ndarray, probe: np.ndarray, base: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members to probe and base members of other components, enough to join all which are linked."""
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, signature, probe, base = size[order], signature[order], probe[order], base[order]
    _, root = np.unique(component[order], return_inverse=True)
    _, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.cumsum(size)
    starts = ends - size
    # Only sets of fitting size can be similar.
    since, until = np.searchsorted(size, -(-percent * size // 100)), np.searchsorted(size, 100 * size // percent, side="right")
    mark, out = np.zeros(int(codes.max()) + 1, bool), []
    for i in np.flatnonzero(probe).tolist():
        others = np.arange(since[i], until[i])
        others = others[base[others] & (root[others] != root[i])]
        count, done = np.zeros(len(others), np.int64), 0
        for upto in (COORDINATES // 2, 3 * COORDINATES // 4, COORDINATES):
            if not len(others):
                break
            count += (signature[others, done:upto] == signature[i, done:upto]).sum(1)
            able = count + (COORDINATES - upto) >= MATCHES
            others, count, done = others[able], count[able], upto
        if not len(others):
            continue
        mark[codes[starts[i] : ends[i]]] = True
        both = np.add.reduceat(mark[codes[ragged(starts[others], size[others])]].astype(np.int64), np.cumsum(size[others]) - size[others])
        mark[codes[starts[i] : ends[i]]] = False
        for j in others[100 * both >= percent * (size[i] + size[others] - both)].tolist():
            if root[j] != root[i]:
                out.append((int(order[i]), int(order[j])))
                root[root == root[j]] = root[i]
    return out


def _merged(postings: DataFrame, signed: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links across components found by merging the postings (pair, doc, size, component, hub_component)."""
    seen, probe = F.xxhash64("doc"), F.col("component") != F.col("hub_component")
    facts = postings.groupBy("pair").agg(
        F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes"), F.count_if(probe).alias("probes"), F.bit_xor(seen).alias("x"), F.bit_xor(F.xxhash64(seen)).alias("y"), F.sum(seen.bitwiseAND(F.lit((1 << 32) - 1))).alias("z")
    )
    # Postings with the same members are one.
    one = facts.groupBy("n", "bytes", "probes", "x", "y", "z").agg(F.min("pair").alias("pair"))
    blocks = lambda many: F.greatest(F.ceil(F.col(many) / TILE_MEMBERS), F.ceil(F.col("bytes") * F.col(many) / F.col("n") / TILE_BYTES), F.lit(1)).cast("long")
    one = stored(one.select("pair", "bytes", blocks("n").alias("of_all"), blocks("probes").alias("of_probes")), "distinct-postings")
    total = one.agg(F.sum(F.col("bytes") * F.col("of_probes"))).first()[0]
    if not total:
        return postings.select(F.col("doc").alias("a"), F.col("doc").alias("b")).limit(0)
    sets = _sets(postings.select(F.col("doc").alias("doc_id")), docs, words).join(signed.select(F.col("doc_id").alias("doc"), "signature"), "doc")
    # One row where there is one tile; else each member for every block of those to probe, and those for every block of all.
    block = lambda of: F.pmod(F.xxhash64("doc", F.lit(1)), F.col(of))
    row = lambda i, j, p, b: F.struct((i * F.col("of_all") + j).alias("tile"), p.alias("probe"), b.alias("base"))
    upto = lambda of: F.sequence(F.lit(0).cast("long"), F.col(of) - 1)
    zero, yes, no = F.lit(0).cast("long"), F.lit(True), F.lit(False)
    as_base = F.transform(upto("of_probes"), lambda i: row(i, block("of_all"), no, yes))
    as_probe = F.when(probe, F.transform(upto("of_all"), lambda j: row(block("of_probes"), j, yes, no)))
    rows = F.when((F.col("of_all") == 1) & (F.col("of_probes") == 1), F.array(row(zero, zero, probe, yes))).otherwise(F.concat(as_base, F.coalesce(as_probe, F.array().cast("array<struct<tile:bigint,probe:boolean,base:boolean>>"))))
    tiled = postings.join(one.drop("bytes"), "pair").select("pair", "doc", "component", F.inline(rows))
    held = tiled.join(sets, "doc").withColumn("bucket", F.pmod(F.xxhash64("pair", "tile"), F.lit(max(1, -(-int(total) // BUCKET_BYTES)))))

    def merge(group: pa.Table) -> pa.Table:
        release()  # what the bucket before left
        pair, tile, doc, component, probe, base = (group.column(c).to_numpy() for c in ("pair", "tile", "doc", "component", "probe", "base"))
        signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES)
        raw = group.column("shingles").combine_chunks()
        order = np.lexsort((doc, tile, pair))
        cut = np.flatnonzero((pair[order][1:] != pair[order][:-1]) | (tile[order][1:] != tile[order][:-1])) + 1
        out = []
        for at in np.split(order, cut):
            if (component[at] != component[at[0]]).any():
                sets_ = [np.frombuffer(raw[int(i)].as_buffer(), "<u8") for i in at]
                out += [(doc[at[i]], doc[at[j]]) for i, j in merge_posting(signature[at], sets_, component[at], probe[at].astype(bool), base[at].astype(bool), percent)]
        return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return held.select("bucket", "pair", "tile", "doc", "component", "probe", "base", "signature", "shingles").groupBy("bucket").applyInArrow(merge, "a long, b long").distinct()


def _mixed(postings: DataFrame, found: DataFrame) -> DataFrame:
    """(pair, doc, size, component, hub_component) of the postings with members in several components."""
    placed = postings.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("pair", "doc", "size", F.coalesce("component", "doc").alias("component"))
    first = F.min(F.struct("doc", "component"))["component"].alias("hub_component")
    mixed = placed.groupBy("pair").agg(first, F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    return placed.join(mixed.select("pair", "hub_component"), "pair")


def group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    docs = id_text(docs)
    signed = stored(signatures(docs, words), "signatures")
    classes = signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    classes = stored(classes, "classes")
    postings = stored(_postings(classes), "postings")
    hubs = stored(postings.groupBy("pair").agg(F.min("doc").alias("hub")), "hubs")
    # Rows of one doc_id belong together, whatever their texts.
    own = signed.join(classes.select("set_key", F.col("doc_id").alias("rep")), "set_key").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps"))
    own = own.filter("a <> b").select("a", F.explode("reps").alias("b")).filter("a <> b")
    star = postings.join(hubs, "pair").filter("doc <> hub").groupBy("doc").agg(F.min("hub").alias("a")).select("a", F.col("doc").alias("b"))
    links = stored(_confirmed(star, classes, docs, words, percent).unionByName(own), "links")
    found = stored(components(links), "components")
    placed = stored(_mixed(postings, found), "placed")
    more = stored(_merged(placed, classes, docs, words, percent), "links")
    if not more.isEmpty():
        found = components(links.unionByName(more))
    found = stored(found, "components")
    named = classes.select("set_key", F.col("doc_id").alias("node")).join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
