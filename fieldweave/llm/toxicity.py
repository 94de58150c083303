"""Toxicity (operator 3): a weighted finite-state grammar over clauses.

Four transducers read the words of a clause as symbols - insult, threat, target, negation, report, other - and are composed
into one machine: negation weakens what it precedes, reported speech weakens the rest of the clause, a target strengthens an
insult and turns a threat into one against somebody. Insults are learned: words that stand in many different contexts of
toxic documents and hardly in others, and stems of such words (contexts, not documents, so copies of one text teach nothing). The scores of matched
clauses, never isolated counts of words, are the inputs of a logistic regression on the labels.

Learning takes at most `sample_rows` labelled rows; the lexicon has at most MAX_INSULTS words. Null and empty texts have no
clause and get the score of a text without a match; a null doc_id is kept; repeated rows are judged row by row; documents
without a label are scored like all others; without labels of both kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, sub_batches, texts_of

MAX_INSULTS = 5000
#: Letters of a stem: inflected and compound forms are learned together, as "stem*".
STEM = 5
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

# Closed-class words of the grammar, in English, German, French and Spanish.
THREATS = "kill hurt destroy beat crush burn attack töten schlagen vernichten zerstören tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours yourself du dich dir dein deine ihr euch euer toi tu vous votre tes usted ustedes tú ti vosotros".split()
NEGATIONS = "not never no isn don didn doesn nicht nie kein keine keinen pas jamais aucun ne nunca jamás ningún".split()
REPORTS = "said says told claimed wrote quoted reported sagte sagt behauptete schrieb dit disait écrit affirme dijo dice escribió afirma".split()

#: A transducer: (state, symbol) -> (next state, symbol passed on, factor, addition); what isn't listed passes unchanged.
Transducer = tuple[int, dict[tuple[int, int], tuple[int, int, float, float]]]


def negation(scope: int = 3) -> Transducer:
    """The `scope` words after a negation count little."""
    moves: dict[tuple[int, int], tuple[int, int, float, float]] = {}
    for state in range(scope + 1):
        for symbol in range(6):
            after = scope if symbol == NEGATION else max(0, state - 1)
            factor = 0.3 if state and symbol in (INSULT, THREAT) else 1.0
            moves[state, symbol] = (after, symbol, factor, 0.0)
    return scope + 1, moves


def reported() -> Transducer:
    """After a verb of saying, the clause is somebody else's."""
    moves = {(0, REPORT): (1, REPORT, 1.0, 0.0)}
    moves |= {(1, s): (1, s, 0.5, 0.0) for s in (INSULT, THREAT)}
    return 2, moves


def threats() -> Transducer:
    """A threat is worth two insults; it passes as an insult."""
    return 1, {(0, THREAT): (0, THREAT, 2.0, 0.0)}


def targets() -> Transducer:
    """State 1: a target was named; state 2: an insult came first. A threat without a target counts little."""
    moves = {}
    for state in range(3):
        moves[state, TARGET] = (1, TARGET, 1.0, 0.5 if state == 2 else 0.0)
        moves[state, INSULT] = (1 if state == 1 else 2, INSULT, 1.5 if state == 1 else 1.0, 0.0)
        moves[state, THREAT] = (state, THREAT, 1.0 if state == 1 else 0.1, 0.0)
    return 3, moves


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What the first passes on, the second reads; factors multiply and additions add."""
    n, a = first
    m, b = second
    moves = {}
    for i in range(n):
        for j in range(m):
            for symbol in range(6):
                to, passed, factor, plus = a.get((i, symbol), (i, symbol, 1.0, 0.0))
                to2, passed2, factor2, plus2 = b.get((j, passed), (j, passed, 1.0, 0.0))
                moves[i * m + j, symbol] = (to * m + to2, passed2, factor * factor2, plus + plus2)
    return n * m, moves


def grammar() -> Transducer:
    return compose(compose(negation(), reported()), compose(threats(), targets()))


def symbols(insults: dict[str, float]) -> dict[str, tuple[int, float]]:
    out = {w: (INSULT, x) for w, x in insults.items()}
    for kind, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        out |= {w: (kind, 1.0) for w in words if w not in insults}
    return out


def look_up(word: str, known: dict[str, tuple[int, float]]) -> tuple[int, float]:
    """Symbol and weight of a word, by itself or by its stem."""
    return known.get(word) or (known.get(word[:STEM] + "*") if len(word) > STEM else None) or (OTHER, 0.0)


def clause_score(words: list[str], known: dict[str, tuple[int, float]], machine: Transducer) -> float:
    state, total = 0, 0.0
    moves = machine[1]
    for w in words:
        symbol, weight = look_up(w, known)
        state, _, factor, plus = moves[state, symbol]
        total += plus + (factor * weight if symbol in (INSULT, THREAT) else 0.0)
    return total


def features(text: str, known: dict[str, tuple[int, float]], machine: Transducer) -> list[float]:
    """Of the matched clauses: the best, the sum (both on a log scale), and whether there are any."""
    low = text.lower()
    scored = {INSULT, THREAT}
    if not any(look_up(w, known)[0] in scored for w in set(WORD.findall(low))):
        return [0.0, 0.0, 0.0]
    scores = [clause_score(WORD.findall(c), known, machine) for c in CLAUSE.split(low)]
    scores = [s for s in scores if s > 0]
    return [float(np.log1p(max(scores))), float(np.log1p(sum(scores))), 1.0] if scores else [0.0, 0.0, 0.0]


def learn_insults(labelled: DataFrame) -> dict[str, float]:
    """Words and their log-odds, by contexts (the word before) in toxic and in other documents."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[str, str, int]] = set()
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                for p, w in zip(["", *words], words, strict=False):
                    if len(w) > 2:
                        seen.add((w, p, toxic))
                    if len(w) > STEM:
                        seen.add((w[:STEM] + "*", p, toxic))
            cols = list(zip(*seen, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], ["word", "before", "toxic"])

    pairs = labelled.select("text", "toxic").mapInArrow(contexts, "word string, before string, toxic int").distinct()
    by_word = pairs.groupBy("word").agg(F.sum(F.col("toxic")).alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    share = labelled.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not share["bad"] or not share["good"]:
        return {}
    odds = F.log((F.col("bad") + 0.5) / share["bad"]) - F.log((F.col("good") + 0.5) / share["good"])
    rows = by_word.filter("bad >= 5").withColumn("odds", odds).filter("odds >= 2.5").orderBy(F.desc("odds"), "word").limit(MAX_INSULTS).collect()
    return {r["word"]: float(r["odds"]) for r in rows}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(docs: DataFrame, insults: dict[str, float], *more: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(insults)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, machine = symbols(sent.value), grammar()
        for batch in batches:
            for part in sub_batches(batch):
                rows = [features(t, known, machine) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(part.column(c) for c in more), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", *more, "features"])

    return docs.mapInArrow(read, "doc_id long, " + "".join(f"{c} int, " for c in more) + "features array<double>")


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, score of every document. labels: (doc_id, toxic) of the rows that may teach."""
    docs = id_text(docs)
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    taught = docs.join(F.broadcast(sample), "doc_id")  # at most sample_rows pairs of numbers
    insults = learn_insults(taught)
    rows = _featured(taught.select("doc_id", "text", "toxic"), insults, "toxic").collect() if insults else []
    weights = logistic(np.array([r["features"] for r in rows]), np.array([r["toxic"] for r in rows], float)) if rows else np.array([0.0, 0.0, 0.0, -50.0])
    x = sum((F.get("features", i) * float(w) for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    return _featured(docs, insults).select("doc_id", (1 / (1 + F.exp(-x))).alias("score"))
