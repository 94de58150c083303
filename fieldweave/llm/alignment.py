"""Cross-tokenizer alignment (operator 11): tokens of two tokenizers over the same bytes, linked where they overlap.

A text with a space before it is encoded by a byte-level tokenizer (A) and by a sentence-piece model (B, which adds that
space). Packed bitsets over the bytes mark where tokens end; their AND has the cuts that both share, their OR the cuts of
either. Popcount ranks turn a cut into a token's index: between two neighbouring cuts of the OR lies the overlap of one pair
of tokens, and each overlapping pair has just one such stretch, so that the links expand from the OR without any search.

How many documents hold an id pair is summed over blocks of documents (blocks.py), dealt by A's id, whose partners are at
most B's vocabulary; each block gets the counts of its own pairs back.

Texts that are null or empty, or whose tokens don't spell them, have no tokens: zeros. A null doc_id is kept; repeated rows
are documents of their own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import Bits, answered, asked, block_ids, dealt, gathered, in_order, pack, unpack
from .common import id_text, ragged, stored, sub_batches, texts_of, tidy
from .pieces import split
from .tokens import Library

#: Text bytes aligned at once, and text bytes whose pairs share one list.
SLICE_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
_SPACE = "▁"
_LOADED: dict[str, object] = {}


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies spell printable Latin-1 characters as themselves and the other bytes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Spelling:
    """Bytes of the tokens of a vocabulary, as one buffer."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.flat[ragged(self.start[ids], self.length[ids])].tobytes()


class Encoded(NamedTuple):
    """Texts as distinct parts: the parts' bytes and ids, joined, with the length of each; the parts of all texts as indices, and the texts' offsets in those."""

    spelt: bytes
    sizes: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray
    codes: np.ndarray
    at: np.ndarray


class ByteLevel(Library):
    """A: each match of the pattern goes to the library once a batch; special strings are plain text."""

    def __init__(self, path: str, pattern: str):
        super().__init__(path, pattern)
        self.tokenizer.encode_special_tokens = True
        self.specials = []
        known = byte_of_character()
        entry = [self.tokenizer.id_to_token(i) for i in range(self.vocab_size)]
        self.spelling = Spelling([bytes(known[c] for c in t) if all(c in known for c in t) else t.encode() for t in entry])

    def tokens(self, texts: list[str]) -> Encoded:
        distinct, codes, at = split(texts, self.pattern)
        sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = distinct.to_pylist()
        coded = self.pieces(pieces)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        return Encoded("".join(pieces).encode(), sizes, np.frombuffer(b"".join(coded), "<u4").astype(np.int64), lengths, codes, at)


class SentencePieces:
    """B: texts are cut where no piece of the vocabulary can reach across, and each distinct part is encoded once a batch.

    No merge spans two characters that stand side by side in no piece. That is looked up in the vocabulary for "anything but
    a space, then a space" and for line feeds on either side; a vocabulary with such pieces gets whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        entry = [self.model.id_to_piece(i) for i in range(n)]
        plain = [e for i, e in enumerate(entry) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.cuts = not any("\n" in e or _SPACE in e.lstrip(_SPACE) for e in plain)
        self.spelling = Spelling([bytes([int(e[3:5], 16)]) if self.model.is_byte(i) else e.replace(_SPACE, " ").encode() for i, e in enumerate(entry)])
        self.feed = self.model.piece_to_id("<0x0A>")

    def tokens(self, texts: list[str]) -> Encoded:
        """`texts` start with the space that the model adds; '' has no tokens."""
        raw = [t.encode() for t in texts]
        joined = b"".join(raw)
        if not self.cuts:
            ids = [np.array(x, np.int64) for x in self.model.encode([t[1:] for t in texts if t], num_threads=1)]
            lengths = np.array([len(x) for x in ids], np.int64)
            return Encoded(joined, np.array([len(x) for x in raw if x], np.int64), np.concatenate([*ids, np.zeros(0, np.int64)]), lengths, np.arange(len(ids)), np.cumsum([0, *map(bool, texts)]))
        buf, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(x) for x in raw])
        start = np.zeros(len(buf) + 1, bool)
        start[1:-1] = ((buf[1:] == 32) & (buf[:-1] != 32)) | (buf[1:] == 10) | (buf[:-1] == 10)
        start[0] = True
        start[ends] = True
        start[-1] = False
        starts = np.flatnonzero(start)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(buf)).astype(np.int32)), pa.py_buffer(joined)]).dictionary_encode()
        distinct = parts.dictionary
        sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = distinct.to_pylist()
        feed = plain.index(b"\n") if b"\n" in plain else None
        if feed is not None:
            del plain[feed]
        # Many parts at once, each after a line feed.
        found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(plain), 4096):
            got = np.array(self.model.encode(b"\n".join([b"", *plain[i : i + 4096]]).decode(), num_threads=1), np.int64)
            after = np.flatnonzero(got == self.feed)
            counts.append(np.diff(np.append(after, len(got))) - 1)
            found.append(np.delete(got[after[0] :], after - after[0]))
        ids, lengths = np.concatenate(found), np.concatenate(counts)
        if feed is not None:
            ids, lengths = np.insert(ids, lengths[:feed].sum(), self.feed), np.insert(lengths, feed, 1)
        return Encoded(b"".join(distinct.to_pylist()), sizes, ids, lengths, parts.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, np.concatenate([[0], ends])))


def _once(key: str, make):
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def _all_tokens(found: Encoded, spelling: Spelling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, the n+1 offsets of the texts in them, and which texts the tokens spell."""
    first = np.cumsum(found.lengths) - found.lengths
    n = np.concatenate([[0], np.cumsum(spelling.length[found.ids])])
    right = n[first + found.lengths] - n[first] == found.sizes
    if not right.all() or spelling.joined(found.ids) != found.spelt:
        at = np.cumsum(found.sizes) - found.sizes
        right = np.array([spelling.joined(found.ids[f : f + k]) == found.spelt[i : i + z] for f, k, i, z in zip(first, found.lengths, at, found.sizes, strict=True)], bool)
    per_code = found.lengths[found.codes]
    ids = found.ids[ragged(first[found.codes], per_code)]
    wrong = np.concatenate([[0], np.cumsum(~right[found.codes])])
    return ids, np.concatenate([[0], np.cumsum(per_code)])[found.at], wrong[found.at[1:]] == wrong[found.at[:-1]]


_SEPARATORS = (b",", b"|", b";")


def _numerals(n: int) -> Spelling:
    return Spelling([b"%d%s" % (i, s) for i in range(n) for s in _SEPARATORS])


def align(texts: list[str], a: ByteLevel, b: SentencePieces) -> dict[str, np.ndarray | list]:
    """Per text n_a, n_b, n_groups, n_links and groups_sha256; per distinct pair of a text its index, both ids and number of links."""
    spaced = [f" {t}" if t and _SPACE not in t else "" for t in texts]
    ids_a, at_a, good_a = _all_tokens(a.tokens(spaced), a.spelling)
    ids_b, at_b, good_b = _all_tokens(b.tokens(spaced), b.spelling)
    good = good_a & good_b
    if not good.all():
        ids_a, ids_b = ids_a[np.repeat(good, np.diff(at_a))], ids_b[np.repeat(good, np.diff(at_b))]
        at_a, at_b = (np.concatenate([[0], np.cumsum(np.where(good, np.diff(x), 0))]) for x in (at_a, at_b))
    ends_a, ends_b = np.cumsum(a.spelling.length[ids_a]), np.cumsum(b.spelling.length[ids_b])
    text_ends = np.concatenate([[0], ends_a])[at_a]
    size = int(text_ends[-1]) + 1
    in_a, in_b = Bits.at(ends_a, size), Bits.at(ends_b, size)
    shared, either = Bits(in_a.words & in_b.words), Bits(in_a.words | in_b.words)
    cuts, stretches = shared.select(), either.select()
    link_a, link_b = ids_a[in_a.rank(stretches)], ids_b[in_b.rank(stretches)]
    links_to, groups_to = either.rank(text_ends + 1), shared.rank(text_ends + 1)
    # Distinct pairs of each text, by one sort.
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(links_to))
    pairs = np.sort((doc << 40) | (link_a << 20) | link_b) if len(doc) else np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(pairs)))
    pairs = pairs[new]
    # Numerals in the order of the groups: those of A up to a cut, then those of B.
    upto_a, upto_b = np.concatenate([[0], in_a.rank(cuts + 1)]), np.concatenate([[0], in_b.rank(cuts + 1)])
    group_a, group_b = shared.rank(ends_a), shared.rank(ends_b)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[upto_a[1:] - 1], last_b[upto_b[1:] - 1] = 1, 2
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + upto_b[group_a]] = ids_a * 3 + last_a
    order[np.arange(len(ids_b)) + upto_a[group_b + 1]] = ids_b * 3 + last_b
    numerals = _once("numerals", lambda: _numerals(max(len(a.spelling.length), len(b.spelling.length))))
    text_at = (at_a + at_b).tolist()
    shas = [hashlib.sha256(numerals.joined(order[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(text_at[:-1], text_at[1:], strict=True)]
    return {
        "n_a": np.diff(at_a), "n_b": np.diff(at_b), "n_groups": np.diff(groups_to), "n_links": np.diff(links_to), "groups_sha256": shas,
        "doc": pairs >> 40, "pair": ((pairs >> 20) & 0xFFFFF) << 32 | (pairs & 0xFFFFF), "times": times,
    }


_PER_TEXT = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = "block long, doc_id array<long>, n_a binary, n_b binary, n_groups binary, n_links binary, groups_sha256 array<string>, keys binary, sums binary, codes binary, held binary, times binary"


def _blocks(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """One row a block: the figures of its texts, its distinct pairs, and each text's pairs as ascending indices into those."""

    def row(number: int, ids: list, found: list[dict]) -> pa.RecordBatch:
        join = lambda k: np.concatenate([f[k] for f in found])
        texts = np.cumsum([0, *(len(f["n_a"]) for f in found)])
        doc = np.concatenate([f["doc"] + t for f, t in zip(found, texts, strict=False)])
        keys, codes, sums = np.unique(join("pair"), return_inverse=True, return_counts=True)
        held = np.bincount(doc, minlength=int(texts[-1]))
        steps = np.diff(codes, prepend=0)
        first = (np.cumsum(held) - held)[held > 0]
        steps[first] = codes[first]
        values = [pack(join(k)) for k in _PER_TEXT]
        cells = [[number], [ids], *([v] for v in values), [[s for f in found for s in f["groups_sha256"]]], [pack(keys, True)], [pack(sums)], [pack(steps)], [pack(held)], [pack(join("times"))]]
        types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4, pa.list_(pa.string()), *[pa.binary()] * 5]
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _once(path_a, lambda: ByteLevel(path_a, pattern)), _once(path_b, lambda: SentencePieces(path_b))
        numbers, ids, found, size = block_ids(), [], [], 0
        for batch in gathered(batches, SLICE_BYTES):
            for part in sub_batches(batch, SLICE_BYTES):
                ids += part.column("doc_id").to_pylist()
                found.append(align(texts_of(part), a, b))
                size += part.nbytes
                if size >= BLOCK_BYTES:
                    yield row(next(numbers), ids, found)
                    ids, found, size = [], [], 0
        if found:
            yield row(next(numbers), ids, found)

    return docs.mapInArrow(tidy(work), _BLOCK)


def _place(keys: np.ndarray, parts: int) -> np.ndarray:
    return dealt(keys >> np.uint64(32), parts)


def _answer(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Documents that hold each pair, and whether no other pair of the A id is in more; all pairs of an A id are here."""
    _, first = np.unique(keys >> np.uint64(32), return_index=True)
    most = np.maximum.reduceat(sums, first) if len(keys) else sums
    return sums, sums == np.repeat(most, np.diff(np.append(first, len(keys))))


def link(docs: DataFrame, path_a: str, pattern: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(_blocks(id_text(docs), path_a, pattern, path_b), "aligned")
    replies = asked(blocks, parts, _place, _answer)
    names = ["doc_id", *_PER_TEXT, "n_best", "count_sum", "groups_sha256"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, steps, times = (unpack(row[k]).astype(np.int64) for k in ("held", "codes", "times"))
                n = len(row["doc_id"])
                doc = np.repeat(np.arange(n), held)
                total = np.concatenate([[0], np.cumsum(steps)])
                codes = total[1:] - np.repeat(total[np.cumsum(held) - held], held)
                count, best = in_order(row["answers"], _place(unpack(row["keys"]), parts), 2)
                n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(n_best, doc, times * best[codes].astype(np.int64))
                np.add.at(count_sum, doc, times * count[codes].astype(np.int64))
                columns = [pa.array(row["doc_id"], pa.int64()), *(pa.array(unpack(row[k]).astype(np.int64)) for k in _PER_TEXT), pa.array(n_best), pa.array(count_sum), pa.array(row["groups_sha256"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names)
    return answered(blocks, replies).drop("sums").mapInArrow(tidy(finish), schema)
