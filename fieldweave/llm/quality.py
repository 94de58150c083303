"""Quality rules by weak supervision (operator 7): rules vote or abstain, expectation-maximisation estimates how often each
is right for good and for bad texts, and a text is kept by its posterior probability.

Counts come from whole texts, batch by batch. Votes meet as patterns: there are at most 3**len(rules()) of them, so the
estimation runs on a table of fixed size, whatever the input; nothing else is collected. The bounds of the rules are near:
good texts cross one now and then, and it takes the estimated weight of the other votes to reject them. Accuracies have
weak priors (PRIOR texts), no bounds.

A null or empty text has no words and fails the base test; lines without a word never count as repeated; null doc_ids and
repeated rows are judged row by row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, prefix_hash, span_hash, stored, sub_batches, tidy, utf8, words_of
from .shingles import window_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_shouts", "n_marks", "n_distinct"]


def _first_seen(values: np.ndarray) -> np.ndarray:
    """True where a value stands for the first time."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch):
                buf, offsets = utf8(part)
                prefix = prefix_hash(buf)
                starts, ends, rows = words_of(buf, offsets)
                hashes = span_hash(prefix, starts, ends)
                inside = np.zeros(len(buf) + 1, np.int64)
                np.add.at(inside, starts, 1)
                np.add.at(inside, ends, -1)
                in_word = np.cumsum(inside[:-1]) > 0
                windows, at = window_hashes(hashes, rows, 5)
                out = {c: np.zeros(len(part), np.int64) for c in COUNTS}
                out["n_words"] = np.diff(rows)
                out["word_chars"] = _sums(in_word & ((buf & 0xC0) != 0x80), offsets)
                out["n_symbols"] = _sums(_SYMBOL[buf], offsets)
                upper = (buf >= 65) & (buf <= 90)
                out["n_upper"] = _sums(upper, offsets)
                out["n_letters"] = _sums(upper | ((buf >= 97) & (buf <= 122)), offsets)
                out["n_shouts"] = _sums(buf == 33, offsets)
                out["n_marks"] = _sums(_MARK[buf], offsets)
                newline = np.flatnonzero(buf == 10)
                for i in range(len(part)):
                    lo, hi, a, b = offsets[i], offsets[i + 1], rows[i], rows[i + 1]
                    if a == b:
                        continue
                    own = newline[np.searchsorted(newline, lo) : np.searchsorted(newline, hi)]
                    line_starts, line_ends = np.concatenate([[lo], own + 1]), np.concatenate([own, [hi]])
                    has = np.searchsorted(starts[a:b], line_ends) > np.searchsorted(starts[a:b], line_starts)
                    lines = span_hash(prefix, line_starts[has], line_ends[has])
                    out["n_lines"][i] = len(lines)
                    out["n_dup_lines"][i] = len(lines) - len(np.unique(lines))
                    out["n_distinct"][i] = len(np.unique(hashes[a:b]))
                    w = windows[at[i] : at[i + 1]]
                    if len(w):
                        _, inverse, n = np.unique(w, return_inverse=True, return_counts=True)
                        twice = np.flatnonzero(n[inverse] > 1)
                        if len(twice):
                            covered = np.zeros(b - a + 1, np.int64)
                            np.add.at(covered, twice, 1)
                            np.add.at(covered, twice + 5, -1)
                            out["n_repeat_words"][i] = int((np.cumsum(covered) > 0).sum())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    return docs.mapInArrow(tidy(count), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(bad: Column, good: Column) -> Column:
    """0 bad, 1 good, 2 abstains."""
    return F.when(bad, 0).when(good, 1).otherwise(2)


def rules() -> list[Column]:
    """Votes of the rules; a rule abstains between its two bounds, and where a text is too short to tell."""
    n, some, enough = F.col("n_words"), F.col("n_words") >= 10, F.col("n_words") >= 20
    per_word = lambda c: F.col(c) / F.greatest(n, F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest("word_chars", F.lit(1))
    upper = F.col("n_upper") / F.greatest("n_letters", F.lit(1))
    lines = F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    return [
        _vote(n < 15, n >= 40),
        _vote(per_word("n_symbols") > 0.15, some & (per_word("n_symbols") < 0.02)),
        _vote(some & (per_word("n_repeat_words") > 0.1), some & (per_word("n_repeat_words") < 0.04)),
        _vote((F.col("n_lines") >= 4) & (lines > 0.34), (F.col("n_lines") >= 4) & (lines < 0.05)),
        _vote(enough & ~per_word("word_chars").between(3.8, 6.5), enough & per_word("word_chars").between(4.2, 6)),
        _vote(enough & (upper > 0.06), enough & (upper < 0.04)),
        _vote(some & (per_word("n_shouts") > 0.05), some & (per_word("n_shouts") < 0.01)),
        _vote((n >= 50) & (per_word("n_distinct") < 0.45), (n.between(50, 2000)) & (per_word("n_distinct") > 0.55)),
        _vote(some & (per_char("n_symbols") > 0.03), some & (per_char("n_symbols") < 0.005)),
        _vote(some & (per_char("n_marks") > 0.15), some & (per_char("n_marks") < 0.08)),
    ]


#: Texts that the prior counts for, and the chances of a vote for bad that it expects of bad and of good texts.
PRIOR, PRIOR_BAD, PRIOR_GOOD = 20.0, 0.5, 0.05


class Estimate:
    """chance[k] = chances of a vote for bad, by rule k if it votes, of bad (0) and good (1) texts; share of good texts."""

    def __init__(self, chance: np.ndarray, share: float):
        self.chance, self.share = chance, share
        self.accuracy = np.stack([chance[:, 0], 1 - chance[:, 1]], 1)
        #: Log odds of good against bad: of no votes, and what each rule's vote (bad, good) adds.
        self.prior = float(np.log(share) - np.log(1 - share))
        self.weight = np.stack([np.log(chance[:, 1] / chance[:, 0]), np.log((1 - chance[:, 1]) / (1 - chance[:, 0]))], 1)

    def odds(self, votes: np.ndarray) -> np.ndarray:
        return self.prior + (votes == 0) @ self.weight[:, 0] + (votes == 1) @ self.weight[:, 1]


def estimate(counts: dict[int, int], n_rules: int, rounds: int = 500) -> Estimate:
    """Expectation-maximisation over the patterns of votes (base 3, rule 0 lowest) and how many texts have each.

    Rules vote independently given what the text is; an abstention says nothing. The first round takes texts with two or
    more votes for bad as bad. Without any texts the estimate is the prior.
    """
    patterns = sorted(counts)
    votes = np.array([[p // 3**k % 3 for k in range(n_rules)] for p in patterns], np.int64).reshape(len(patterns), n_rules)
    weight = np.array([counts[p] for p in patterns], float)
    good = np.where((votes == 0).sum(1) >= 2, 0.0, 1.0)
    for _ in range(rounds):
        mass = np.stack([(1 - good) * weight, good * weight])
        bad_votes, voted = mass @ (votes == 0), mass @ (votes < 2)
        expected = np.array([[PRIOR_BAD], [PRIOR_GOOD]])
        chance = ((bad_votes + PRIOR * expected) / (voted + PRIOR)).T
        found = Estimate(chance, float((mass[1].sum() + PRIOR / 2) / (weight.sum() + PRIOR)))
        before, good = good, 1 / (1 + np.exp(-np.clip(found.odds(votes), -500, 500)))
        if not len(good) or np.abs(good - before).max() < 1e-9:
            break
    return found


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, quality (posterior probability), kept of every document."""
    votes = rules()
    pattern = sum((v * 3**k for k, v in enumerate(votes)), F.lit(0))
    counted = stored(statistics(id_text(docs)).withColumn("pattern", pattern), "quality")
    seen = {r["pattern"]: r["n"] for r in counted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    found = estimate(seen, len(votes))
    odds = sum((F.when(v == 0, float(w[0])).when(v == 1, float(w[1])).otherwise(0.0) for v, w in zip(votes, found.weight, strict=True)), F.lit(found.prior))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = counted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).drop("pattern")
