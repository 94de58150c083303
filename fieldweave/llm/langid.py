"""Language identification (operator 9): sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the lower-cased text are hashed to FEATURES columns; document frequencies come from all
learnable documents. Weights are trained by follow-the-regularised-leader with elastic-net penalties on a sample of at most
`sample_rows` learnable documents, in SHARDS shards whose weights are averaged; a temperature fitted on a part of the sample
that the training leaves out calibrates the probabilities. What reaches the driver is bounded by FEATURES, the number of
languages and `sample_rows`.

A null text or one without a letter is `und` with score 0, as is everything if nothing can be learned; a null doc_id is kept;
repeated rows are drawn and judged row by row, whatever their doc_id; ties go to the first language in alphabetical order; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, ship, stored, sub_batches, texts_of

FEATURES = 1 << 14
SHARDS = 6
_LETTER = regex.compile(r"\p{L}")


def counts_of(texts: list[str]) -> np.ndarray:
    """N-gram counts, one row a text."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(t) for t in low], np.int64)
    row = np.repeat(np.arange(len(low)), sizes + 1)
    inside = np.ones(len(code), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    total = np.zeros(len(low) * FEATURES, np.float32)
    gram = np.zeros(len(code), np.uint64)
    for n in range(3):
        m = len(code) - n
        if m <= 0:
            break
        gram = (gram[:m] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[n:] + np.uint64(1) + np.uint64(n << 32))
        ok = inside[:m].copy()
        for k in range(1, n + 1):
            ok &= inside[k : m + k]
        at = ((gram * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(50)).astype(np.int64)
        total += np.bincount((row[:m] * FEATURES + at)[ok], minlength=len(total)).astype(np.float32)
    return total.reshape(len(low), FEATURES)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _groups(batch: pa.RecordBatch, most: int = 128) -> Iterator[pa.RecordBatch]:
    for part in sub_batches(batch, 1 << 20):
        for i in range(0, len(part), most):
            yield part.slice(i, most)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each feature the number of documents that have it, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for part in _groups(batch):
                total[:-1] += (counts_of(texts_of(part)) > 0).sum(0)
                total[-1] += len(part)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["at", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def ftrl(x: np.ndarray, y: np.ndarray, classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights [feature, class] by the per-coordinate FTRL-proximal rule; only features of the row at hand move."""
    z = np.zeros((x.shape[1], classes))
    n = np.zeros_like(z)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(epochs):
        for row, label in zip(x, y, strict=True):
            at = np.flatnonzero(row)
            w = weights(at)
            logits = row[at] @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = row[at][:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a geometric grid."""
    if not len(y):
        return 1.0
    best = (np.inf, 1.0)
    for t in np.geomspace(0.02, 20, 200):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        loss = float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())
        best = min(best, (loss, float(t)))
    return best[1]


def drawn(learn: DataFrame, n: int, most: int) -> DataFrame:
    """At most `most` of the n rows, with a draw of their own each: repeated rows and rows of one doc_id are drawn one by one.

    Twice as many as needed are written first, so that the draws stay as they are; the least `most` of those count.
    """
    marked = learn.select("text", "lang", F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text", F.monotonically_increasing_id()).alias("draw"))
    share = min(1.0, (2 * most + 100) / n)
    held = stored(marked.filter(F.col("draw") < int(-(1 << 63) + share * (1 << 64)) if share < 1 else F.lit(True)), "drawn")
    last = held.select("draw").orderBy("draw").limit(most).agg(F.max("draw")).first()[0]
    return held.filter(F.col("draw") <= last)


def fit(learn: DataFrame, sample_rows: int = 4000, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> dict:
    """learn: doc_id, text, lang (not null)."""
    langs = sorted(r["lang"] for r in learn.select("lang").distinct().collect())
    df, n = document_frequencies(learn)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    model = {"langs": langs, "idf": idf, "weights": np.zeros((FEATURES, max(1, len(langs))), np.float32), "temperature": 1.0}
    if not n:
        return model
    sample = drawn(learn, n, sample_rows).select("text", "lang", F.pmod(F.xxhash64("draw"), F.lit(SHARDS + 1)).cast("int").alias("shard"))
    sent = learn.sparkSession.sparkContext.broadcast((langs, idf))
    kind = pa.schema([("shard", pa.int32()), ("at", pa.int32()), ("values", pa.list_(pa.float64()))])

    def train(key: tuple, group: pa.Table) -> pa.Table:
        """Weights of a shard; of shard 0, which no other sees, nothing."""
        langs, idf = sent.value
        if key[0].as_py() == 0:
            return pa.Table.from_pylist([], kind)
        place = {x: i for i, x in enumerate(langs)}
        y = np.array([place[v] for v in group.column("lang").to_pylist()], np.int64)
        x = np.concatenate([tf_idf(counts_of(texts_of(b)), idf) for b in group.to_batches(max_chunksize=128)])
        order = np.random.default_rng(key[0].as_py()).permutation(len(y))
        w = ftrl(x[order], y[order], len(langs), epochs, alpha, beta, l1, l2)
        used = np.flatnonzero(np.abs(w).sum(1))
        return pa.table([pa.array(np.full(len(used), key[0].as_py(), np.int32)), pa.array(used.astype(np.int32)), pa.array(w[used].tolist(), pa.list_(pa.float64()))], schema=kind)

    shards = sample.groupBy("shard").applyInArrow(train, "shard int, at int, values array<double>").collect()
    many = max(1, len({r["shard"] for r in shards}))
    for r in shards:
        model["weights"][r["at"]] += np.array(r["values"], np.float32) / many
    weights = learn.sparkSession.sparkContext.broadcast(model["weights"])

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, idf = sent.value
        for batch in batches:
            for part in _groups(batch):
                logits = tf_idf(counts_of(texts_of(part)), idf) @ weights.value
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(logits.astype(float).tolist(), pa.list_(pa.float64()))], ["lang", "logits"])

    rows = sample.filter("shard = 0").select("text", "lang").mapInArrow(left_out, "lang string, logits array<double>").collect()
    if rows:  # else the shard left out is empty, and nothing calibrates
        model["temperature"] = temperature(np.array([r["logits"] for r in rows]).reshape(len(rows), -1), np.array([langs.index(r["lang"]) for r in rows], np.int64))
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability) of every document."""
    docs = id_text(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in _groups(batch):
                texts = texts_of(part)
                known = [bool(m["langs"]) and _LETTER.search(t) is not None for t in texts]
                logits = tf_idf(counts_of(texts), m["idf"]) @ m["weights"] / m["temperature"]
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                langs = [m["langs"][b] if k else "und" for b, k in zip(best, known, strict=True)]
                score = np.where(known, p[np.arange(len(best)), best], 0.0).astype(float)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.mapInArrow(judge, "doc_id long, lang_pred string, score double")


def learnable(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, text, lang of the documents that may teach."""
    ship(docs.sparkSession)
    return docs.filter("lang is not null and text is not null").filter(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
