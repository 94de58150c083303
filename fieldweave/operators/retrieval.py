"""Retrieval over bags of words and dense vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..packaging import ship


def _terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Words of each key with their counts. Texts travel once, by key: sums and ranks by key then need no further shuffle while the other side is small."""
    return rows.select(F.col(key), F.col(text)).repartition(F.col(key)).select(F.col(key), F.explode(T.tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def _ranked(scored: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, query: str, doc: str) -> DataFrame:
    """The k best documents of every query; where fewer score above zero, the first other documents follow with zero.

    A query with fewer than k hits finds enough others among the first 2 k documents, which are all that is sent to it.
    """
    best = scored.filter("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), doc))).filter(F.col("rank") <= k)
    hits = best.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", doc, "score"))).alias("hits"))
    others = F.array(*map(F.lit, [r[0] for r in corpus.select(doc).distinct().orderBy(doc).limit(2 * k).collect()]))
    none = F.array().cast(hits.schema["hits"].dataType)
    found = queries.select(query).distinct().join(hits, query, "left").withColumn("hits", F.coalesce("hits", none))
    rest = F.filter(others, lambda x: ~F.exists("hits", lambda h: h[doc] == x))
    both = F.concat(F.transform("hits", lambda h: F.struct(h[doc].alias(doc), h["score"].alias("score"))), F.transform(rest, lambda x: F.struct(x.alias(doc), F.lit(0.0).alias("score"))))
    return found.select(query, F.posexplode(F.slice(both, 1, k)).alias("at", "hit")).select(query, f"hit.{doc}", "hit.score", (F.col("at") + 1).alias("rank"))


def lexical_scores(queries: DataFrame, corpus: DataFrame, query: str = "query", doc: str = "doc", text: str = "text") -> DataFrame:
    """Cosine over raw word counts of each query and document that share a word."""
    q, d = _terms(queries, query, text), _terms(corpus, doc, text)
    norm = lambda t, key, name: t.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(name))
    dots = q.withColumnRenamed("n", "qn").join(d, "term").groupBy(query, doc).agg(F.sum(F.col("qn") * F.col("n")).alias("dot"))
    scored = dots.join(norm(q, query, "q_norm"), query).join(norm(d, doc, "d_norm"), doc)
    return scored.select(query, doc, F.round(F.col("dot") / (F.col("q_norm") * F.col("d_norm")), 6).alias("score"))


def lexical(queries: DataFrame, corpus: DataFrame, k: int, query: str = "query", doc: str = "doc", text: str = "text") -> DataFrame:
    """The k documents of highest cosine over raw word counts with each query; 0 where no word is shared."""
    return _ranked(lexical_scores(queries, corpus, query, doc, text), queries, corpus, k, query, doc)


def tfidf_scores(queries: DataFrame, corpus: DataFrame, query: str = "query", doc: str = "doc", text: str = "text") -> DataFrame:
    """TF-IDF cosine of each query and document that share a word; each query counts as a member of the corpus.

    A query adds one to the document frequency of its own words, so a document's norm differs by query: the norm without it
    is corrected by the words they share, in the join that yields the products.
    """
    n = corpus.count() + 1
    idf = lambda df: F.log((1.0 + n) / (1.0 + df)) + 1.0
    q, d = _terms(queries, query, text).withColumnRenamed("n", "qn"), _terms(corpus, doc, text)
    df = d.groupBy("term").agg(F.count("*").alias("df"))
    d = d.join(df, "term").select(doc, "term", (F.col("n") * idf(F.col("df"))).alias("plain"), (F.col("n") * idf(F.col("df") + 1)).alias("asked"))
    q = q.join(df, "term", "left").select(query, "term", (F.col("qn") * idf(F.coalesce("df", F.lit(0)) + 1)).alias("w"))
    square = lambda c: F.col(c) * F.col(c)
    shift = F.sum(square("asked") - square("plain")).alias("shift")
    dots = q.join(d, "term").groupBy(query, doc).agg(F.sum(F.col("w") * F.col("asked")).alias("dot"), shift)
    norms = q.groupBy(query).agg(F.sum(square("w")).alias("q_norm")), d.groupBy(doc).agg(F.sum(square("plain")).alias("d_norm"))
    scored = dots.join(norms[0], query).join(norms[1], doc)
    return scored.select(query, doc, F.round(F.col("dot") / F.sqrt(F.col("q_norm") * (F.col("d_norm") + F.col("shift"))), 6).alias("score"))


def tfidf(queries: DataFrame, corpus: DataFrame, k: int, query: str = "query", doc: str = "doc", text: str = "text") -> DataFrame:
    """The k documents of highest TF-IDF cosine with each query; 0 where no word is shared."""
    return _ranked(tfidf_scores(queries, corpus, query, doc, text), queries, corpus, k, query, doc)


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(key, vector, group) rows as blocks of up to `most`: keys, vectors end to end as doubles, groups."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                flat = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([flat.tobytes()], pa.binary()), pa.array([part.column(2).to_pylist()], pa.list_(pa.string()))], ["keys", "flat", "groups"])

    return rows.mapInArrow(pack, "keys array<long>, flat binary, groups array<string>")


def dense(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, most: int = 1024, within: str | None = None) -> DataFrame:
    """The k other vectors of largest inner product of each query, from all of the corpus; with `within`, from the rows that share its non-blank value.

    Queries and corpus travel as blocks of up to `most` vectors; every block of the one meets every block of the other in
    some task, which keeps the k best of each query, so that corpus blocks x queries x k rows are ranked. Nothing passes
    through the driver. Rows without a vector are left out.
    """
    side = lambda f: f.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector, (T.clean(F.col(within)) if within else F.lit("")).alias("_group"))
    asked = _packed(side(queries), most).select(F.col("keys").alias("q_keys"), F.col("flat").alias("q_flat"), F.col("groups").alias("q_groups"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]  # one pair of blocks at a time: a batch holds many
                docs, ids = np.array(row["keys"], np.int64), np.array(row["q_keys"], np.int64)
                rows, wanted = (np.frombuffer(row[c], np.float64).reshape(n, -1) for c, n in (("flat", len(docs)), ("q_flat", len(ids))))
                scores = np.round(wanted @ rows.T, 5)
                scores[ids[:, None] == docs[None, :]] = -np.inf
                if within:
                    own, other = np.array(row["q_groups"], object), np.array(row["groups"], object)
                    scores[(own[:, None] != other[None, :]) | (own == "")[:, None]] = -np.inf
                order = np.argsort(docs, kind="stable")
                first = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
                found = np.take_along_axis(scores, first, 1)
                held = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, held.sum(1))), pa.array(docs[first][held]), pa.array(found[held])], ["query", "doc", "score"])

    met = _packed(side(corpus), most).crossJoin(asked)  # blocks, not rows
    found = met.mapInArrow(best, "query long, doc long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")))
    return ranked.filter(F.col("rank") <= k)


#: Words (rows of key and word) that a slice of queries or of the corpus holds on average, and words of one product of blocks.
SLICE_WORDS = 1 << 20
BLOCK, BLOCK_WORDS = 512, 2048
#: Meetings of a word in a pair of blocks up to which they are gone through one by one, and meetings that are open at once.
FEW_MEETINGS, MEETINGS = 2048, 1 << 21


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero, as SQL rounds."""
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits


class _Side:
    """Rows of one slice as arrays: ids, vectors (NaN without one), groups, and words end to end with their counts and weights."""

    def __init__(self, part: pa.Table, n_docs: int, corpus: bool):
        self.ids = part.column("id").to_numpy()
        self.group = np.array(part.column("g").to_pylist(), object)
        vectors = part.column("v").to_pylist()
        width = max((len(v) for v in vectors if v is not None), default=0)
        self.vector = np.array([[np.nan] * width if v is None or len(v) != width else v for v in vectors], np.float64).reshape(len(part), width)
        words, n, df = (part.column(c).combine_chunks() for c in ("words", "n", "df"))
        self.row = np.repeat(np.arange(len(part)), np.diff(words.offsets.to_numpy()))
        self.word, self.n, df = words.flatten().to_numpy(), n.flatten().to_numpy().astype(np.float64), df.flatten().to_numpy().astype(np.float64)
        idf = lambda d: np.log((1.0 + n_docs) / (1.0 + d)) + 1.0
        self.asked = self.n * idf(df + 1)
        plain = self.n * idf(df) if corpus else self.asked
        self.shift = self.asked**2 - plain**2
        total = lambda w: np.bincount(self.row, w, len(part))
        self.counts, self.norm = total(self.n**2), total(plain**2)

    def block(self, first: int, last: int) -> _Block:
        """The rows from first to last by word."""
        at = np.arange(*np.searchsorted(self.row, [first, last]))
        at = at[np.argsort(self.word[at], kind="stable")]
        words, start = np.unique(self.word[at], return_index=True)
        return _Block(first, last, words, start, np.diff(np.append(start, len(at))), self.row[at] - first, self.n[at], self.asked[at], self.shift[at])


class _Block(NamedTuple):
    """Rows of a block by word: different words in order, where each begins and how often it stands, then row, count and weights of each."""

    first: int
    last: int
    words: np.ndarray
    start: np.ndarray
    often: np.ndarray
    row: np.ndarray
    n: np.ndarray
    asked: np.ndarray
    shift: np.ndarray


def _ranges(start: np.ndarray, often: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (as many as `often` says) of each range, end to end."""
    return np.arange(often.sum()) + np.repeat(start - np.cumsum(often) + often, often)


def _products(q: _Block, d: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the words that a query and a row share: of the products of counts, of the products of weights, of the rows' shifts.

    Words that stand in many rows of both blocks are multiplied as matrices; most words stand in few, and their meetings are added one by one.
    """
    shape = (q.last - q.first, d.last - d.first)
    plain, dot, shift = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    _, in_q, in_d = np.intersect1d(q.words, d.words, assume_unique=True, return_indices=True)
    meetings = q.often[in_q] * d.often[in_d]
    frequent = meetings > FEW_MEETINGS
    for start in range(0, int(frequent.sum()), BLOCK_WORDS):

        def laid(b: _Block, at: np.ndarray, rows: int, *weights: np.ndarray | float, start: int = start) -> Iterator[np.ndarray]:
            at = at[frequent][start : start + BLOCK_WORDS]
            own, word = _ranges(b.start[at], b.often[at]), np.repeat(np.arange(len(at)), b.often[at])
            for w in weights:
                out = np.zeros((rows, len(at)))
                out[b.row[own], word] = w[own] if isinstance(w, np.ndarray) else w
                yield out

        for total, x, y in zip((plain, dot, shift), laid(q, in_q, shape[0], q.n, q.asked, 1.0), laid(d, in_d, shape[1], d.n, d.asked, d.shift), strict=True):
            total += x @ y.T
    in_q, in_d, meetings = in_q[~frequent], in_d[~frequent], meetings[~frequent]
    part = np.cumsum(meetings) // MEETINGS
    for i in range(int(part[-1]) + 1 if len(part) else 0):
        of_q, of_d = in_q[part == i], in_d[part == i]
        own = _ranges(q.start[of_q], q.often[of_q])
        many = np.repeat(d.often[of_d], q.often[of_q])
        other = _ranges(np.repeat(d.start[of_d], q.often[of_q]), many)
        own = np.repeat(own, many)
        cell = q.row[own] * shape[1] + d.row[other]
        for total, w in ((plain, q.n[own] * d.n[other]), (dot, q.asked[own] * d.asked[other]), (shift, d.shift[other])):
            total += np.bincount(cell, w, total.size).reshape(shape)
    return plain, dot, shift


def _text_means(q: _Side, d: _Side, of_q: _Block, of_d: _Block) -> np.ndarray:
    """Mean of both text cosines of the queries and documents of two blocks; 0 where no word is shared."""
    plain, dot, shift = _products(of_q, of_d)
    q0, q1, d0, d1 = of_q.first, of_q.last, of_d.first, of_d.last
    with np.errstate(divide="ignore", invalid="ignore"):
        lexical_ = plain / (np.sqrt(q.counts[q0:q1])[:, None] * np.sqrt(d.counts[d0:d1])[None, :])
        tfidf_ = dot / np.sqrt(q.norm[q0:q1][:, None] * (d.norm[d0:d1][None, :] + shift))
    return np.where(plain > 0, (_rounded(lexical_, 6) + _rounded(tfidf_, 6)) / 2, 0.0)


def hybrid(queries: DataFrame, corpus: DataFrame, key: str, vector: str, text: str, group: str, k: int, weights: tuple[float, float, float] = (0.45, 0.45, 0.10)) -> DataFrame:
    """The k other rows of highest sum of inner product, mean of both text cosines, and a bonus for an equal non-blank group, weighted.

    Nearly every query shares a word with nearly every row, so pairs never become rows: slices of queries and of the corpus,
    cut by their number of words, meet in one task for each pair of slices, are multiplied block by block there, and only the
    k best of each query leave it. Words are told apart by 64-bit hashes. Rows without a key are left out; those without a
    vector have no score and come last.
    """
    ship(queries.sparkSession)
    asked, rows = queries.filter(F.col(key).isNotNull()), corpus.filter(F.col(key).isNotNull())
    n_docs = rows.select(key).count() + 1
    hashed = lambda f: _terms(f, key, text).select(F.col(key), F.xxhash64("term").alias("word"), "n")
    words = hashed(rows)
    df = words.groupBy("word").agg(F.count("*").cast("int").alias("df"))

    def side(f: DataFrame, own: DataFrame) -> tuple[DataFrame, int]:
        slices = max(1, -(-own.count() // SLICE_WORDS))
        held = own.join(df, "word", "left").groupBy(key).agg(F.collect_list(F.struct("word", F.col("n").cast("int").alias("n"), F.coalesce("df", F.lit(0)).alias("df"))).alias("w"))
        columns = f.select(F.col(key), F.col(vector).cast("array<double>").alias("v"), T.clean(F.col(group)).alias("g")).join(held, key, "left")
        of = lambda c, kind: F.coalesce(F.col(f"w.{c}"), F.array().cast(f"array<{kind}>")).alias(c)
        return columns.select(F.col(key).cast("long").alias("id"), "v", "g", of("word", "long").alias("words"), of("n", "int"), of("df", "int"), F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice")), slices

    (left, q_slices), (right, d_slices) = side(asked, hashed(asked)), side(rows, words)
    cell = lambda f, at, n: f.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")).select("*", at.alias("cell")).drop("slice", "other")
    left, right = cell(left, F.col("slice") * d_slices + F.col("other"), d_slices), cell(right, F.col("other") * d_slices + F.col("slice"), q_slices)
    names = ["query", "doc", "visual_similarity", "text_similarity", "group_bonus", "score"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), *[pa.float64()] * 4], strict=True)))

    def best(asked_: pa.Table, rows_: pa.Table) -> pa.Table:
        out = []
        if len(asked_) and len(rows_):
            q, d = _Side(asked_, n_docs, False), _Side(rows_.take(pa.compute.sort_indices(rows_.column("id"))), n_docs, True)
            d_blocks = [d.block(d0, min(d0 + BLOCK, len(d.ids))) for d0 in range(0, len(d.ids), BLOCK)]
            for q0 in range(0, len(q.ids), BLOCK):
                q1 = min(q0 + BLOCK, len(q.ids))
                ids, kept, q_block = q.ids[q0:q1], None, q.block(q0, q1)
                for d_block in d_blocks:
                    d0, d1 = d_block.first, d_block.last
                    docs = np.broadcast_to(d.ids[d0:d1], (q1 - q0, d1 - d0))
                    own, other = q.group[q0:q1], d.group[d0:d1]
                    parts = _rounded(q.vector[q0:q1] @ d.vector[d0:d1].T, 5) if q.vector.shape[1] == d.vector.shape[1] else np.full(docs.shape, np.nan), _rounded(_text_means(q, d, q_block, d_block), 7), ((own[:, None] == other[None, :]) & (own != "")[:, None]).astype(float)
                    score = _rounded(sum(w * p for w, p in zip(weights, parts, strict=True)), 9)
                    # Rank: -inf for what has no score, NaN for what is no hit; documents come in order, so ties stay in it.
                    rank = np.where(docs == ids[:, None], np.nan, np.where(np.isnan(score), -np.inf, score))
                    found = [docs, *parts, score, rank] if kept is None else [np.concatenate(x, axis=1) for x in zip(kept, [docs, *parts, score, rank], strict=True)]
                    first = np.argsort(-found[-1], axis=1, kind="stable")[:, :k]
                    kept = [np.take_along_axis(x, first, 1) for x in found]
                held = ~np.isnan(kept[-1])
                cols = [np.repeat(ids, held.sum(1)), *(x[held] for x in kept[:-1])]
                out.append(pa.table([pa.array(c, f.type, from_pandas=True) for c, f in zip(cols, schema, strict=True)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(best, "query long, doc long, visual_similarity double, text_similarity double, group_bonus double, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")))
    return ranked.filter(F.col("rank") <= k)
