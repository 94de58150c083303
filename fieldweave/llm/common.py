"""Shared plumbing of the corpus operators: table reading, shared-folder tables, Arrow batches, numpy text primitives."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass works on inside a task.
SUB_BATCH_BYTES = 1 << 20

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, once, as spark-submit --py-files would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    # Literals of a plan (a rank map) would otherwise fill the driver with plan descriptions.
    spark.conf.set("spark.sql.maxPlanStringLength", "65536")
    # Texts are long: ten thousand of them at once are more than a Python worker should hold.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fieldweave-")), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(at, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(at)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset in local mode (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "at" not in _OWN_DIR:
        _OWN_DIR["at"] = tempfile.mkdtemp(prefix="fieldweave-")
    return _OWN_DIR["at"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the frame as compressed Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fieldweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy_driver(spark: SparkSession) -> None:
    """Drops what earlier operators left on the driver: broadcasts and shuffles of frames that are gone, freed heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # Spark's cleaner follows the collector, which a long session seldom needs
    release()


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only what an operator needs; columns with clashing names never meet."""
    ship(docs.sparkSession)
    tidy_driver(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def sub_batches(batch: pa.RecordBatch, limit: int = SUB_BATCH_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of text each (a longer text makes a slice of its own)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def release() -> None:
    """Gives freed memory back to the machine; otherwise Arrow's pool and the C library keep it for later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task with release() at its end: Python workers wait for other tasks beside those that run."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the polynomial hashes below, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, key: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * np.uint64(step)
            done += more
            step = step * step % (1 << 64)
        _POWERS[key] = have = out
    return have[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of (b_j + 1) * BASE**j for j < i, so that span_hash needs two look-ups."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(buf), "up"), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end), wherever they stand."""
    return mix64((prefix[ends] - prefix[starts]) * _powers(BASE_INV, len(prefix), "down")[starts])


def utf8(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and the n+1 offsets of its rows in them; nulls are empty."""
    col = batch.column(column).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], (offsets - offsets[0]) if len(offsets) else np.zeros(1, np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each row: starts, ends, and the n+1 offsets of the rows in them."""
    is_word = ~_SPACE[buf]
    start = is_word.copy()
    start[1:] &= ~is_word[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(buf)]
    start[inner] = is_word[inner]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:]
    cut = inner[inner > 0] - 1
    end[cut] = is_word[cut]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)
