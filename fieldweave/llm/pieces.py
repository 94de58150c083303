"""Byte-pair pieces: the pattern that splits text before the merges, run over whole batches.

Texts whose characters all lie below U+0100 are split with numpy: the pattern only tells letters, numbers, white space
and the rest apart, so its matches follow from the classes of neighbouring characters. Other texts go through the pattern itself.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, OTHER, WHITE, END = range(5)
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}


def _class(i: int) -> int:
    if i in _WHITE:
        return WHITE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], OTHER)


_CLASS = np.array([_class(i) for i in range(256)], np.uint8)
_PATTERNS: dict[str, regex.Pattern] = {}


def compiled(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode has it (Python's own also counts U+001C to U+001F)."""
    if pattern not in _PATTERNS:
        inside = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        _PATTERNS[pattern] = regex.compile(inside)
    return _PATTERNS[pattern]


def _starts(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where matches start in Latin-1 text; `ends` are the positions of the separators after each text."""
    kind = _CLASS[buf]
    kind[ends] = END
    start = np.ones(len(buf), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[ends] = True
    start[ends[:-1] + 1] = True
    # The last character of a white run before something else stands alone, or leads the next match if it is a space.
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] < WHITE))
    start[last] = True
    start[last[buf[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll take letters away from the run after the apostrophe.
    quote = np.flatnonzero((buf[:-1] == 39) & start[:-1] & (kind[:-1] == OTHER) & (kind[1:] == LETTER))
    if len(quote):
        one = buf[quote + 1]
        two = buf[np.minimum(quote + 2, len(buf) - 1)]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        double &= kind[np.minimum(quote + 2, len(buf) - 1)] == LETTER
        for q, n in ((quote[single], 2), (quote[double], 3)):
            start[q + 1] = False
            start[q + n] = True
    return np.flatnonzero(start), kind


def split(texts: list[str], pattern: str) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct pieces of the texts, the index of every piece in text order, and the n+1 offsets of the texts in those.

    Distinct pieces may stand twice in the list (once from either way of splitting); null texts are given as ''.
    """
    plain: list[bytes] = []
    others: list[int] = []
    for i, text in enumerate(texts):
        try:
            plain.append(text.encode("latin-1"))
        except UnicodeEncodeError:
            plain.append(b"")
            others.append(i)
    joined = b"\n".join([*plain, b""])
    buf = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.array([len(x) + 1 for x in plain], np.int64)) - 1
    starts, kind = _starts(buf, ends) if len(ends) else (np.zeros(0, np.int64), buf)
    offsets = np.append(starts, len(buf)).astype(np.int32)
    spans = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    coded = spans.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = kind[starts] != END
    where = np.cumsum(~real)
    counts = np.bincount(where[real], minlength=len(texts)).astype(np.int64)
    distinct = [x.decode("latin-1") for x in coded.dictionary.to_pylist()]
    codes = codes[real].astype(np.int64)
    if others:
        find = compiled(pattern).findall
        found = [find(texts[i]) for i in others]
        more = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
        own = more.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(distinct)
        distinct += more.dictionary.to_pylist()
        at = np.concatenate([[0], np.cumsum(counts)])
        took = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        parts, before = [], 0
        for k, i in enumerate(others):
            parts += [codes[at[before] : at[i]], own[took[k] : took[k + 1]]]
            before = i
            counts[i] = len(found[k])
        codes = np.concatenate([*parts, codes[at[before] :]])
    return pa.array(distinct, pa.string()), codes, np.concatenate([[0], np.cumsum(counts)])
