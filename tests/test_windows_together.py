"""Windows of many pairs take their steps together, and forms are made once a row."""

import contextlib
import io
import random

from fieldweave import catalog
from fieldweave.functions import similarity as S


def by_windows(a, b):
    """Longest common subsequences by their table, window by window."""
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            left = 0
            for j, d in enumerate(y, 1):
                row[j], left = max(row[j], row[j - 1], left + 1 if c == d else 0), row[j]
        return row[-1]
    if len(a) == len(b) and a != b:
        return max(best(a, b, lcs), best(b, a, lcs))
    return best(*sorted((a, b), key=len), lcs)


def best(short, long, lcs):
    if not short:
        return float(not long)
    cuts = [long[max(k, 0) : k + len(short)] for k in range(1 - len(short), len(long))]
    return max(2 * lcs(short, w) / (len(short) + len(w)) for w in cuts)


def test_pairs_of_all_lengths(monkeypatch):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices("ab \u00e9\U0001f600\ud800", k=n))
    pairs = [(text(rng.randint(0, 8)), text(rng.randint(0, 12))) for _ in range(300)] + [(text(m), text(n)) for m in (1, 63, 64, 65, 128, 130) for n in (0, 1, 63, 64, 65, 140)] + [("ab", "ab"), ("", "")]
    want = [by_windows(a, b) for a, b in pairs]
    for room in (1, 500, 1 << 14):
        monkeypatch.setattr(S, "_WINDOW_WORDS", room)
        assert S.window_ratios(*map(list, zip(*pairs))).tolist() == want


def test_many_pairs_take_few_calls(monkeypatch):
    calls, own = [], S._best_windows
    monkeypatch.setattr(S, "_best_windows", lambda *a: calls.append(1) or own(*a))
    S.window_ratios([f"red {i}" for i in range(1000)], ["large ring of brass"] * 1000)
    assert len(calls) <= 3


def test_forms_are_made_once_a_row(spark):
    with contextlib.redirect_stdout(out := io.StringIO()):
        catalog.queries()["partial_presence"](spark, "/root/testdata/sf0.001").explain()
    assert out.getvalue().count("regexp_replace(") <= 6
