"""Token counts by overlap resynchronisation (operator 5), and the piece-wise use of the tokenizers library.

Texts up to `chunk_chars` are counted at once. Longer ones become overlapping chunks, spread over the tasks and encoded
apart; where two chunks overlap, a position at which a piece starts in both, away from either cut, is proven stable: the
pattern looks only forward, so from there on both go the same way. Chunks are spliced there. Documents with an overlap
that has no such position are encoded again with wider overlaps, in the end as one chunk.

Nulls and empty texts have no tokens; a null doc_id is kept; repeated rows are counted row by row; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, ragged, stored, sub_batches, texts_of
from .pieces import split

#: Pieces that a worker remembers at most.
CACHE_PIECES = 1 << 20
_LOADED: dict[str, Library] = {}


class Library:
    """A tokenizer file of the tokenizers library inside a worker, with a bounded memory of pieces."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.pattern = pattern
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.specials = [x["content"] for x in said["added_tokens"]]
        self.margin = 16 + max((len(x.encode()) for x in self.specials), default=0)
        self.vocab_size = self.tokenizer.get_vocab_size()
        # Bytes of each id: a character of a byte-level token stands for one byte, an added token for itself.
        self.byte_length = np.zeros(self.vocab_size, np.int64)
        for piece, i in said["model"]["vocab"].items():
            self.byte_length[i] = len(piece)
        for x in said["added_tokens"]:
            self.byte_length[x["id"]] = len(x["content"].encode())
        self.memory: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Library:
        if path not in _LOADED:
            _LOADED[path] = cls(path, pattern)
        return _LOADED[path]

    def pieces(self, distinct: list[str]) -> list[bytes]:
        """Ids of pieces as little-endian unsigned 32-bit integers."""
        memory = self.memory
        new = [x for x in distinct if x not in memory]
        if len(memory) + len(new) > CACHE_PIECES:
            memory.clear()
            new = distinct
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            raw, ends = np.array([x for own in ids for x in own], "<u4").tobytes(), np.cumsum([4 * len(own) for own in ids]).tolist()
            memory.update(zip(part, (raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)), strict=True))
        return [memory[x] for x in distinct]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n+1 offsets of the texts in them. Texts with an added token go to the library whole."""
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.specials)}
        distinct, codes, offsets = split(["" if i in whole else t for i, t in enumerate(texts)], self.pattern)
        coded = self.pieces(distinct.to_pylist())
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), "<u4")
        per_piece = lengths[codes]
        ids = flat[ragged((np.cumsum(lengths) - lengths)[codes], per_piece)]
        ends = np.concatenate([[0], np.cumsum(per_piece)])[offsets]
        if whole:
            parts = [ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
            for i in whole:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4")
            ids = np.concatenate(parts)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, ends.astype(np.int64)


def _short(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.of(path, pattern)
        for batch in batches:
            for part in sub_batches(batch):
                texts = texts_of(part)
                _, ends = library.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(np.diff(ends))], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def _chunks(docs: DataFrame, step: int, overlap: int, path: str, pattern: str) -> DataFrame:
    """One row a chunk: its tokens, and where pieces start in the overlaps at its head and tail (document byte, tokens before)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), texts_of(batch), strict=True):
                at, rows = 0, []
                for k, start in enumerate(range(0, max(1, len(text)), step)):
                    last = start + step + overlap >= len(text)
                    rows.append((row, k, at, last, text[start : start + step + overlap] if not last else text[start:]))
                    at += len(text[start : start + step].encode())
                    if last:
                        break
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["row", "k", "at", "last", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library.of(path, pattern)
        schema = pa.schema([("row", pa.string()), ("k", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("head", "head_n", "tail", "tail_n"))])
        for batch in batches:
            out = []
            for row, k, at, last, chunk in zip(*(batch.column(c).to_pylist() for c in ("row", "k", "at", "last", "chunk")), strict=True):
                e = library.tokenizer.encode(chunk, add_special_tokens=False)
                word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
                ends = np.cumsum(library.byte_length[np.array(e.ids, np.int64)]) if len(word) else np.zeros(0, np.int64)
                new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
                pos = np.concatenate([[0], ends])[new]
                n_bytes = len(chunk.encode())
                head = (pos >= library.margin) & (pos <= len(chunk[:overlap].encode())) & (k > 0)
                tail = (pos >= len(chunk[:step].encode())) & (pos <= n_bytes - library.margin) & (not last)
                out.append((row, k, last, len(word), *(x[m].tolist() for m in (head, tail) for x in (pos + at, new))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema)

    chunks = docs.select("row", "text").mapInArrow(cut, "row string, k long, at long, last boolean, chunk string")
    spread = chunks.repartition("row", "k")
    return spread.mapInArrow(encode, "row string, k long, last boolean, n long, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>")


def _spliced(chunks: DataFrame) -> DataFrame:
    """row, n_tokens, aligned: tokens of each document, or not aligned where an overlap has no stable boundary."""
    here = chunks.drop("head", "head_n")
    after = chunks.select("row", (F.col("k") - 1).alias("k"), "head", "head_n")
    pairs = here.join(after, ["row", "k"], "left")
    cut = F.array_min(F.array_intersect("tail", "head"))
    found = pairs.select("row", "last", "n", "tail", "tail_n", "head", "head_n", cut.alias("cut"))
    before = F.get("tail_n", (F.array_position("tail", F.col("cut")) - 1).cast("int"))
    skipped = F.get("head_n", (F.array_position("head", F.col("cut")) - 1).cast("int"))
    own = F.when(F.col("last"), F.col("n")).otherwise(before - skipped)
    return found.groupBy("row").agg(F.sum(own).alias("n_tokens"), F.bool_and(F.col("last") | F.col("cut").isNotNull()).alias("aligned"))


def count_tokens(docs: DataFrame, path: str, pattern: str, chunk_chars: int = 16384, overlap_chars: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document, as the library would count its whole text."""
    docs = id_text(docs)
    short = F.coalesce(F.length("text"), F.lit(0)) <= chunk_chars
    parts = [_short(docs.filter(short), path, pattern)]
    # Rows are told apart by a key of their own, for repeated or null doc_ids.
    left = docs.filter(~short).select("doc_id", "text", F.concat_ws("-", F.col("doc_id"), F.sha2("text", 256)).alias("row"))
    step, overlap = chunk_chars, overlap_chars
    keys = left.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first(F.octet_length("text").cast("long")).alias("n_bytes"), F.count("*").alias("copies"))
    counted, todo = None, left
    while True:
        chunks = stored(_chunks(todo, step, overlap, path, pattern).dropDuplicates(["row", "k"]), "chunks")
        done = stored(_spliced(chunks), "spliced")
        good = done.filter("aligned").select("row", "n_tokens")
        counted = good if counted is None else counted.unionByName(good)
        bad = done.filter("not aligned").select("row")
        if bad.isEmpty():
            break
        todo = left.join(bad, "row", "left_semi")
        overlap *= 8
        step = max(step, 4 * overlap)
    each = keys.join(counted, "row").select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return parts[0].unionByName(each)
