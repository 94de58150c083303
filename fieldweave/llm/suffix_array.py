"""Two-stage suffix sorting of a piece of text, to a depth, with numpy."""

from __future__ import annotations

import numpy as np

#: Stands after each text; no byte of UTF-8 text.
STOP = 255


def smaller_than_next(buf: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one isn't."""
    n = len(buf)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = np.flatnonzero(buf[1:] != buf[:-1])
    if not len(differs):
        return out
    rising = buf[differs] < buf[differs + 1]
    where = np.searchsorted(differs, np.arange(n))
    ok = where < len(differs)
    out[ok] = rising[where[ok]]
    return out


def _with_successors(wanted: np.ndarray, direct: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The wanted positions, and after each the positions up to the next one that is sorted directly."""
    ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    at = np.searchsorted(chosen, ends)
    until = np.append(chosen, len(wanted) - 1)[at]
    mark = np.zeros(len(wanted) + 1, np.int64)
    np.add.at(mark, ends, 1)
    np.add.at(mark, until + 1, -1)
    return wanted | (np.cumsum(mark[:-1]) > 0)


def _sorted_directly(buf: np.ndarray, chosen: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first `depth` bytes; one pair of leading bytes after the other, to hold few keys at once."""
    if not len(chosen):
        return chosen
    text = buf.tobytes().decode("latin-1")
    lead = buf[chosen].astype(np.int64) * 256 + buf[np.minimum(chosen + 1, len(buf) - 1)]
    by_lead = np.argsort(lead, kind="stable")
    out = []
    for group in np.split(chosen[by_lead], np.flatnonzero(np.diff(lead[by_lead])) + 1):
        at = group.tolist()
        at.sort(key=lambda i: text[i : i + depth])
        out.append(np.array(at, np.int64))
    return np.concatenate(out)


def sort(buf: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of buf in the order of their first `depth` bytes (ties in any order); of `wanted` ones and few others, if given.

    Suffixes smaller than their successors are sorted directly. A suffix that is larger begins with a byte no smaller than
    the next one's, so a scan of the buckets of first bytes, from low to high, meets its successor before it, and gives its
    place. A suffix at the end of the text counts as larger.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    direct = smaller_than_next(buf)
    chosen = np.flatnonzero(direct)
    use = np.ones(n, bool) if wanted is None else _with_successors(wanted, direct, chosen)
    placed = _sorted_directly(buf, chosen[use[chosen]], depth)
    by_first = np.searchsorted(buf[placed], np.arange(257)) if len(placed) else np.zeros(257, np.int64)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    if use[n - 1]:
        larger[buf[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        found = larger[c]
        # Runs of one byte lead within the bucket.
        front = np.concatenate(found) if found else np.zeros(0, np.int64)
        level, levels = front, [front]
        while len(level):
            before = level[level > 0] - 1
            level = before[(buf[before] == c) & ~direct[before] & use[before]]
            levels.append(level)
        bucket = np.concatenate([*levels, placed[by_first[c] : by_first[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(buf[before] > c) & use[before]]
        if len(before):
            first = buf[before]
            stable = np.argsort(first, kind="stable")
            cut = np.flatnonzero(np.diff(first[stable])) + 1
            for part in np.split(before[stable], cut):
                larger[buf[part[0]]].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def words8(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one number, past the end zeros."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    out = np.zeros(len(buf), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(buf)]
    return out


def common_prefixes(buf: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` and the one before it, up to depth (a multiple of 8; counted in eights)."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    eight = np.concatenate([words8(buf), np.zeros(depth, np.uint64)])
    live = np.arange(1, len(order))
    for k in range(0, depth, 8):
        live = live[eight[order[live] + k] == eight[order[live - 1] + k]]
        if not len(live):
            break
        out[live] = k + 8
    return out
