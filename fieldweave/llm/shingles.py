"""Word shingles of whole batches as 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import lower_ascii, mix64, prefix_hash, span_hash, utf8, words_of

_ODD = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def word_hashes(batch: pa.RecordBatch, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all rows, and the n+1 offsets of the rows in them."""
    buf, offsets = utf8(batch)
    buf = lower_ascii(buf) if lower else buf
    starts, ends, rows = words_of(buf, offsets)
    return span_hash(prefix_hash(buf), starts, ends), rows


def window_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row, and the offsets of the rows in them."""
    counts = np.diff(rows)
    have = np.maximum(counts - n + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(have)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    total = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _ODD[k]
    at = np.repeat(rows[:-1] - offsets[:-1], have) + np.arange(offsets[-1])
    return mix64(total[at]), offsets


def shingle_sets(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each row; a row of fewer words, but not none, has one of all its words."""
    words, rows = word_hashes(batch)
    all_, offsets = window_hashes(words, rows, n)
    out = []
    for i in range(len(rows) - 1):
        many = rows[i + 1] - rows[i]
        if many >= n:
            out.append(np.unique(all_[offsets[i] : offsets[i + 1]]))
        elif many:
            own = words[rows[i] : rows[i + 1]] * np.array(_ODD[: int(many)])
            out.append(mix64(np.array([own.sum(dtype=np.uint64) + np.uint64(many)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
