"""Likeness of texts: the ratio of matching blocks (Ratcliff and Obershelp), and the best window of a long text for a short one.

Both run as Arrow-fed pandas functions on many pairs at once: numpy works on all open segments, or on all windows, of a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..packaging import ship
from . import text as T

#: From this length of the second text on, characters that make up more than a hundredth of it start no block.
POPULAR_FROM, POPULAR_SHARE = 200, 100
#: Cells of the run tables that are open at once.
_CELLS = 1 << 21
#: Words of the window states that are open at once; one pair may have more.
_WINDOW_WORDS = 1 << 14


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts and a zero, and where each text begins and the last ends."""
    points = np.frombuffer(("".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points, np.cumsum([0, *map(len, texts)])


def _window(flat: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, filler: int) -> np.ndarray:
    """Rows of `width` characters from each start, with a filler from each end on."""
    at = start[:, None] + np.arange(width)
    return np.where(at < end[:, None], flat[np.minimum(at, len(flat) - 1)], filler)


def _longest(a: np.ndarray, b: np.ndarray, seed: np.ndarray, lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of the longest block of each segment; of equal ones the first in a, then in b.

    Runs of equal characters are followed row by row (a row a character of a, over all characters of b), for all segments
    together. Characters that start no block are left out of the runs and added at either end of the block found.
    """
    n = len(lo_a)
    rows, width = _window(a, lo_a, hi_a, int((hi_a - lo_a).max()), -1), int((hi_b - lo_b).max())
    columns = _window(seed, lo_b, hi_b, width, -2)
    run = np.zeros((n, width + 1), np.int32)
    size, end_a, end_b = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(rows.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * (columns == rows[:, i : i + 1])
        best = run.max(axis=1)
        better = np.flatnonzero(best > size)
        if len(better):
            size[better], end_a[better], end_b[better] = best[better], i + 1, run[better].argmax(axis=1)
    start_a, start_b = lo_a + np.where(size > 0, end_a - size, 0), lo_b + np.where(size > 0, end_b - size, 0)
    grow = np.arange(n)
    while len(grow):
        grow = grow[(start_a[grow] > lo_a[grow]) & (start_b[grow] > lo_b[grow])]
        grow = grow[a[start_a[grow] - 1] == b[start_b[grow] - 1]]
        start_a[grow], start_b[grow], size[grow] = start_a[grow] - 1, start_b[grow] - 1, size[grow] + 1
    grow = np.arange(n)
    while len(grow):
        grow = grow[(start_a[grow] + size[grow] < hi_a[grow]) & (start_b[grow] + size[grow] < hi_b[grow])]
        grow = grow[a[start_a[grow] + size[grow]] == b[start_b[grow] + size[grow]]]
        size[grow] += 1
    return start_a, start_b, size


def matching_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the characters in matching blocks by those of both texts; 1 for two empty texts.

    The longest common block comes first, then those left and right of it, and so on. The ratio depends on the order of the
    two texts where blocks tie, and where the second text has popular characters.
    """
    a, at_a = _joined(left)
    b, at_b = _joined(right)
    seed = b.copy()
    for i in np.flatnonzero(np.diff(at_b) >= POPULAR_FROM):
        own = seed[at_b[i] : at_b[i + 1]]
        value, where, count = np.unique(own, return_inverse=True, return_counts=True)
        own[(count > len(own) // POPULAR_SHARE + 1)[where]] = -3
        del value
    matched = np.zeros(len(left), np.int64)
    todo = [np.arange(len(left)), at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]]
    while len(todo[0]):
        some = (todo[2] > todo[1]) & (todo[4] > todo[3])
        todo = [x[some] for x in todo]
        order = np.lexsort((todo[2] - todo[1], todo[4] - todo[3]))
        todo = [x[order] for x in todo]
        later: list[list[np.ndarray]] = []
        at = 0
        while at < len(order):
            widths = (todo[4] - todo[3])[at:]
            lengths = np.maximum.accumulate((todo[2] - todo[1])[at:])
            cells = np.arange(1, len(widths) + 1) * np.maximum(widths, lengths)
            end = at + max(1, int(np.searchsorted(cells, _CELLS, side="right")))
            pair, lo_a, hi_a, lo_b, hi_b = (x[at:end] for x in todo)
            i, j, k = _longest(a, b, seed, lo_a, hi_a, lo_b, hi_b)
            np.add.at(matched, pair, k)
            hit = k > 0
            for part in ((pair, lo_a, i, lo_b, j), (pair, i + k, hi_a, j + k, hi_b)):
                later.append([x[hit] for x in part])
            at = end
        todo = [np.concatenate([x[c] for x in later]) if later else np.zeros(0, np.int64) for c in range(5)]
    both = np.diff(at_a) + np.diff(at_b)
    return np.where(both > 0, 2.0 * matched / np.maximum(both, 1), 1.0)


def _masks(short: np.ndarray, at_short: np.ndarray, long: np.ndarray, pair: np.ndarray, words: int) -> np.ndarray:
    """For each character of `long`, the places in the short text of its pair that hold it, one bit each."""
    if not len(short):
        return np.zeros((len(long), words), np.uint64)
    sizes = np.diff(at_short)
    own = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(short)) - at_short[own]
    key = own << 32 | short
    order = np.argsort(key, kind="stable")
    known, first = np.unique(key[order], return_index=True)
    masks = np.zeros((len(known) + 1, words), np.uint64)  # the last row is for characters that the short text lacks
    for w in range(words):
        bit = np.where(place >> 6 == w, np.uint64(1) << (place & 63).astype(np.uint64), np.uint64(0))
        masks[:-1, w] = np.bitwise_or.reduceat(bit[order], first)
    wanted = pair << 32 | long
    found = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return masks[np.where(known[found] == wanted, found, len(known))]


def _best_windows(shorts: list[str], longs: list[str]) -> np.ndarray:
    """For each pair the largest 2 * LCS / (sum of lengths) of the short text and a window of the long one of its length, cut off at either end.

    One bit a character of a short text, in as many 64-bit words as the longest needs; the windows of all pairs take one step a
    character together. `shorts` has no empty text and comes by falling length, so that the pairs still at work are the first ones.
    """
    short, at_short = _joined(shorts)
    long, at_long = _joined(longs)
    m, n = np.diff(at_short), np.diff(at_long)
    words = (int(m[0]) + 63) // 64
    pairs = np.arange(len(m))
    # The long texts lie one after another, each between places that match nothing: a window may begin before its text and end behind it.
    span = n + 2 * (m - 1)
    at = np.concatenate([[0], np.cumsum(span)])
    own = np.repeat(pairs, n)
    masks = np.zeros((int(at[-1]) + 1, words), np.uint64)
    masks[np.arange(len(own)) - at_long[own] + (at[:-1] + m - 1)[own]] = _masks(short[:-1], at_short, long[:-1], own, words)
    state = np.full((int(at[-1]), words), ~np.uint64(0))
    left = np.searchsorted(-m, -np.arange(int(m[0])), side="left")  # pairs of more than k characters
    for k in range(int(m[0])):
        # The last k places of the last pair begin no window.
        size = int(at[left[k]]) - k
        now, carry = state[:size], np.zeros(size, np.uint64)
        for w in range(words):
            mask, word = masks[k : k + size, w], now[:, w]
            partial = word + (word & mask)
            total = partial + carry
            if w + 1 < words:
                carry = ((partial < word) | (total < partial)).astype(np.uint64)
            now[:, w] = total | (word & ~mask)
    starts = n + m - 1
    first = np.concatenate([[0], np.cumsum(starts)])
    own = np.repeat(pairs, starts)
    place = np.arange(int(first[-1])) - first[own]
    windows = ~state[place + at[own]]
    common = np.zeros(len(place), np.int64)
    for w in range(words):
        used = np.clip(m - 64 * w, 0, 64)
        mask = np.where(used == 64, ~np.uint64(0), (np.uint64(1) << (used & 63).astype(np.uint64)) - np.uint64(1))
        common += np.bitwise_count(windows[:, w] & mask[own])
    start = place + 1 - m[own]
    size = np.minimum(start + m[own], n[own]) - np.maximum(start, 0)
    return np.maximum.reduceat(2.0 * common / (m[own] + size), first[:-1])


def window_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair the best window of the longer text for the shorter one; of equally long ones the better way round."""
    shorter = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(left, right, strict=True)]
    out = np.array([float(x == y) for x, y in shorter])
    todo = [(i, x, y) for i, (x, y) in enumerate(shorter) if x and x != y]
    todo += [(i, y, x) for i, x, y in todo if len(x) == len(y)]
    todo.sort(key=lambda t: -len(t[1]))
    at = 0
    while at < len(todo):
        # Pairs of short texts of as many words, up to a number of words in all.
        words = (len(todo[at][1]) + 63) // 64
        end, cells = at, 0
        while end < len(todo) and (len(todo[end][1]) + 63) // 64 == words and (end == at or cells < _WINDOW_WORDS):
            cells += (len(todo[end][2]) + 2 * len(todo[end][1])) * words
            end += 1
        pairs, shorts, longs = zip(*todo[at:end], strict=True)
        np.maximum.at(out, list(pairs), _best_windows(list(shorts), list(longs)))
        at = end
    return out


def _applied(kernel, left: Column, right: Column) -> Column:
    """The kernel over the distinct pairs of each batch; null where either text is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        if known.any():
            pairs = pd.MultiIndex.from_arrays([a[known], b[known]])
            codes, distinct = pd.factorize(pairs)
            out[known] = kernel(list(distinct.get_level_values(0)), list(distinct.get_level_values(1)))[codes]
        return pd.Series(out).where(known, None).astype("float64")

    session = SparkSession.getActiveSession()
    if session is not None:
        ship(session)
    return F.pandas_udf(run, "double")(left, right)


def matching_ratio(left: Column, right: Column) -> Column:
    return _applied(matching_ratios, left, right)


def window_ratio(left: Column, right: Column) -> Column:
    return _applied(window_ratios, left, right)


def text_similarity(left: Column, right: Column) -> Column:
    """matching_ratio of the letters and digits of both texts in lower case; 0 where either has none."""
    a, b = T.alnum_key(T.clean(left)), T.alnum_key(T.clean(right))
    return F.when((a == "") | (b == ""), 0.0).otherwise(matching_ratio(a, b))


def matchable(c: Column) -> Column:
    """Lower case, with a blank for every run of other characters than letters a-z, digits, points and hyphens."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(T.clean(c)), r"[^a-z0-9.\- ]+", " "), r"\s+", " "), "^ | $", "")


def literal_presence(value: Column, text: Column) -> Column:
    """Whether the text holds the value, in matchable form; null for a blank value."""
    return literal_of(matchable(value), matchable(text))


def normalised_presence(value: Column, text: Column) -> Column:
    """1 if the text holds the value, else the ratio of the best window, 0 without a text; null for a blank value."""
    return presence_of(matchable(value), matchable(text))


def literal_of(v: Column, t: Column) -> Column:
    """literal_presence of forms that are matchable already."""
    return F.when(v != "", F.contains(t, v).cast("int"))


def presence_of(v: Column, t: Column) -> Column:
    """normalised_presence of forms that are matchable already; best given as columns, since each is used several times."""
    unsure = (v != "") & (t != "") & ~F.contains(t, v)
    ratio = window_ratio(F.when(unsure, v), F.when(unsure, t))
    return F.when(v == "", None).when(t == "", 0.0).when(F.contains(t, v), 1.0).otherwise(ratio)


def collector_reading(text: Column, source: Column, least: float = 0.55) -> Column:
    """(verdict, agreement) of the reading of a collector's region: an initial will do, or enough likeness to what the sheet's own text says."""
    value = T.clean(text)
    agreement = text_similarity(text, source)
    verdict = F.when(value == "", "empty_output").when(value.rlike(r"(?:^|\s)[A-Z]\."), "collector_initial").when(agreement >= least, "collector_ocr_agreement").otherwise("collector_unconfirmed")
    return F.struct(verdict.alias("verdict"), agreement.alias("agreement"))
