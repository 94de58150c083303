"""Sums over shared words: rare words meet one by one, frequent ones as matrices, with the same result."""

import numpy as np
import pyarrow as pa
import pytest

from fieldweave.operators import retrieval


def side(rng, rows, corpus):
    words = [sorted(rng.choice(40, rng.integers(0, 12), replace=False) ** 2) for _ in range(rows)]
    counts = [[int(x) for x in rng.integers(1, 5, len(w))] for w in words]
    df = [[int(x) % 7 for x in w] for w in words]
    arrays = [pa.array(range(rows), pa.int64()), pa.array([None] * rows, pa.list_(pa.float64())), pa.array([""] * rows), pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(df, pa.list_(pa.int32()))]
    return retrieval._Side(pa.table(arrays, ["id", "v", "g", "words", "n", "df"]), 50, corpus)


@pytest.mark.parametrize(("few", "open_"), [(0, 9), (3, 7), (10**9, 5), (10**9, 1 << 20)])
def test_products(monkeypatch, few, open_):
    monkeypatch.setattr(retrieval, "FEW_MEETINGS", few)
    monkeypatch.setattr(retrieval, "MEETINGS", open_)
    monkeypatch.setattr(retrieval, "BLOCK_WORDS", 3)
    rng = np.random.default_rng(1)
    q, d = side(rng, 9, False), side(rng, 14, True)
    got = retrieval._products(q.block(2, 9), d.block(3, 12))
    want = np.zeros((3, 7, 9))
    for i in range(len(q.word)):
        for j in range(len(d.word)):
            if q.word[i] == d.word[j] and 2 <= q.row[i] < 9 and 3 <= d.row[j] < 12:
                want[:, q.row[i] - 2, d.row[j] - 3] += q.n[i] * d.n[j], q.asked[i] * d.asked[j], d.shift[j]
    assert want.any() and all(np.allclose(x, y) for x, y in zip(got, want))


def test_rare_words_make_no_matrices(monkeypatch):
    """Words that stand in one row of a block each are added one by one; as columns of matrices they cost rows x rows each."""
    made = []
    zeros = np.zeros
    rng = np.random.default_rng(2)
    q, d = side(rng, 9, False), side(rng, 14, True)
    monkeypatch.setattr(retrieval.np, "zeros", lambda shape, *a: made.append(shape) or zeros(shape, *a))
    retrieval._products(q.block(0, 9), d.block(0, 14))
    assert made == [(9, 14)] * 3
