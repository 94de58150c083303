"""Benchmark decontamination (operator 4): one Aho-Corasick automaton over word windows of all test items.

Texts and items are normalised byte for byte (A-Z to lower case, everything that is no word byte to a blank), so a match in
the joined words leads back to byte offsets of the original. Every document is scanned once for each automaton. Windows are
broadcast; where they exceed `max_block_bytes` they are dealt to several automata, applied one after the other.

Null and empty texts have no words; an item without words matches nothing; repeated items each count; a null item_id is
never listed, but its item's windows count as hit; extra columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, stored, tidy, words_of

_BLANK = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The automaton that this worker has built last, under a key of its scan: workers outlive scans.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BLANK).split()


def windows(items: list[tuple[str | None, str | None]], size: int) -> dict[str, tuple[int, list[str]]]:
    """' w1 .. wn ' -> (number of words, ids of the items that hold it, null ones left out)."""
    out: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        words = [w.decode() for w in normalised(text)]
        for i in range(max(1, len(words) - size + 1)) if words else ():
            own = words[i : i + size]
            names = out.setdefault(f" {' '.join(own)} ", (len(own), []))[1]
            if item is not None:
                names.append(item)
    return out


def _automaton(key: str, items: list[tuple[str | None, str | None]], size: int) -> ahocorasick.Automaton:
    if key not in _BUILT:
        _BUILT.clear()
        found = ahocorasick.Automaton()
        for text, value in windows(items, size).items():
            found.add_word(text, value)
        if len(found):
            found.make_automaton()
        _BUILT[key] = found
    return _BUILT[key]


def _hits(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, merged runs of hit words, items that occur."""
    words = normalised(text)
    if not words or not len(automaton):
        return len(words), [], set()
    joined = f" {b' '.join(words).decode()} "
    found = list(automaton.iter(joined))
    if not found:
        return len(words), [], set()
    blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), "<u4") == 32)
    last = np.searchsorted(blanks, [e for e, _ in found])
    spans, items = [], set()
    for end, (_, (n, own)) in sorted(zip(last.tolist(), found, strict=True), key=lambda x: (x[0] - x[1][1][0], x[0])):
        items.update(own)
        if spans and end - n <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], end))
        else:
            spans.append((end - n, end))
    return len(words), spans, items


def scan(docs: DataFrame, items: DataFrame, size: int = 10, max_block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, spans (byte offsets of hit runs in the original text), items (sorted ids) of every document."""
    spark = docs.sparkSession
    docs = id_text(docs)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # An automaton takes about `size` times the bytes of its items.
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total * size // max_block_bytes))
    state = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("words"), F.array().cast("array<string>").alias("items"))
    for k in range(blocks):
        own = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        sent = spark.sparkContext.broadcast(own)
        key = uuid.uuid4().hex

        def search(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, sent.value, size)
            for batch in batches:
                counts, runs, names = [], [], []
                for text, before, had in zip(*(batch.column(c).to_pylist() for c in ("text", "words", "items")), strict=True):
                    n, spans, found = _hits(text, automaton)
                    counts.append(n)
                    runs.append(before + [x for s in spans for x in s])
                    names.append(sorted({*had, *found}))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "words", "items"])

        state = state.mapInArrow(tidy(search), "doc_id long, text string, n_words long, words array<long>, items array<string>")
        if k < blocks - 1:
            state = stored(state, "scanned")

    def original(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hit words as byte offsets."""
        for batch in batches:
            n_hit, spans = [], []
            for text, words in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted(zip(words[::2], words[1::2], strict=True)):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                n_hit.append(sum(b - a for a, b in merged))
                if merged:
                    buf = np.frombuffer(text.encode().translate(_BLANK), np.uint8)
                    starts, ends, _ = words_of(buf, np.array([0, len(buf)]))
                    merged = [[int(starts[a]), int(ends[b - 1])] for a, b in merged]
                spans.append([{"start": a, "end": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(spans, kind), batch.column("items")], ["doc_id", "n_words", "n_hit", "spans", "items"])

    return state.mapInArrow(tidy(original), "doc_id long, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>")
