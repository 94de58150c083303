"""Image files checked by their own structure: headers, segments and ends, so that a cut-off file is told from a whole one.

Files are read by Spark where they lie; each is walked in the task that holds it. No pixel is decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..packaging import ship

# Suffixes by kind of image.
SUFFIXES = {"jpeg": ["jpg", "jpeg"], "png": ["png"], "gif": ["gif"], "webp": ["webp"], "tiff": ["tif", "tiff"], "bmp": ["bmp"]}
Size = tuple[int, int]


class Cut(Exception):
    """The file ends before its structure does."""


class Broken(Exception):
    """The structure isn't that of the kind."""


def _take(data: bytes, at: int, form: str) -> tuple:
    if at + struct.calcsize(form) > len(data):
        raise Cut
    return struct.unpack_from(form, data, at)


def _png(data: bytes) -> Size:
    at, size = 8, None
    while True:
        length, name = _take(data, at, ">I4s")
        if at + 12 + length > len(data):
            raise Cut
        if zlib.crc32(data[at + 4 : at + 8 + length]) != _take(data, at + 8 + length, ">I")[0]:
            raise Broken
        if size is None:
            if name != b"IHDR":
                raise Broken
            size = _take(data, at + 8, ">II")
        if name == b"IEND":
            return size
        at += 12 + length


def _jpeg(data: bytes) -> Size:
    at, size = 2, None
    while True:
        (marker,) = _take(data, at, ">H")
        if marker >> 8 != 0xFF:
            raise Broken
        kind = marker & 0xFF
        if kind == 0xD9:
            if size is None:
                raise Broken
            return size
        if kind == 0xFF:  # a filler
            at += 1
            continue
        if kind == 0x01 or 0xD0 <= kind <= 0xD7:
            at += 2
            continue
        (length,) = _take(data, at + 2, ">H")
        if length < 2:
            raise Broken
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = _take(data, at + 5, ">HH")
            size = (width, height)
        at += 2 + length
        if at > len(data):
            raise Cut
        if kind == 0xDA:  # coded data up to the next marker that is no stuffing and no restart
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise Cut
                if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7 and data[at + 1] != 0xFF:
                    break
                at += 1 if data[at + 1] == 0xFF else 2


def _gif(data: bytes) -> Size:
    width, height, flags = _take(data, 6, "<HHB")
    at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(at: int) -> int:
        while True:
            (n,) = _take(data, at, "B")
            at += 1 + n
            if not n:
                return at

    while True:
        (kind,) = _take(data, at, "B")
        if kind == 0x3B:
            return width, height
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C:
            (flags,) = _take(data, at + 9, "B")
            at = blocks(at + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0))
        else:
            raise Broken


def _webp(data: bytes) -> Size:
    (length,) = _take(data, 4, "<I")
    if data[8:12] != b"WEBP":
        raise Broken
    if length + 8 > len(data):
        raise Cut
    kind = data[12:16]
    if kind == b"VP8 ":
        width, height = _take(data, 26, "<HH")
        return width & 0x3FFF, height & 0x3FFF
    if kind == b"VP8L":
        (bits,) = _take(data, 21, "<I")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8X":
        a, b, c, d, e, f = _take(data, 24, "6B")
        return (a | b << 8 | c << 16) + 1, (d | e << 8 | f << 16) + 1
    raise Broken


def _tiff(data: bytes) -> Size:
    order = "<" if data[:2] == b"II" else ">"
    (at,) = _take(data, 4, f"{order}I")
    (n,) = _take(data, at, f"{order}H")
    kinds, found, strips = {1: "B", 3: "H", 4: "I"}, {}, {}
    for i in range(n):
        tag, kind, count = _take(data, at + 2 + 12 * i, f"{order}HHI")
        if tag in (256, 257, 273, 279, 324, 325) and kind in kinds:
            form = f"{order}{count}{kinds[kind]}"
            where = at + 10 + 12 * i if struct.calcsize(form) <= 4 else _take(data, at + 10 + 12 * i, f"{order}I")[0]
            found[tag] = _take(data, where, form)
    for starts, sizes in ((273, 279), (324, 325)):
        strips |= dict(zip(found.get(starts, ()), found.get(sizes, ()), strict=False))
    if 256 not in found or 257 not in found or not strips:
        raise Broken
    if any(start + size > len(data) for start, size in strips.items()):
        raise Cut
    return found[256][0], found[257][0]


def _bmp(data: bytes) -> Size:
    (length,) = _take(data, 2, "<I")
    width, height = _take(data, 18, "<ii")
    if length > len(data):
        raise Cut
    return width, abs(height)


_KINDS = [("png", b"\x89PNG\r\n\x1a\n", _png), ("jpeg", b"\xff\xd8\xff", _jpeg), ("gif", b"GIF87a", _gif), ("gif", b"GIF89a", _gif), ("webp", b"RIFF", _webp), ("tiff", b"II*\x00", _tiff), ("tiff", b"MM\x00*", _tiff), ("bmp", b"BM", _bmp)]


def inspect(data: bytes) -> tuple[str, str | None, int | None, int | None]:
    """(status, kind, width, height): valid, truncated, invalid, or undecodable for no known kind."""
    for kind, first, walk in _KINDS:
        if data.startswith(first):
            try:
                width, height = walk(data)
            except Cut:
                return "truncated", kind, None, None
            except (Broken, struct.error):
                return "invalid", kind, None, None
            return ("valid" if width > 0 and height > 0 else "invalid"), kind, width, height
    return "undecodable", None, None, None


def _empty(spark: SparkSession, path: str) -> list[str]:
    """Names of files without a byte, which Spark's readers leave out; from the listing that a reader makes too."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for top in files.globStatus(at) or [] for s in (files.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return [s.getPath().getName() for s in found if s.isFile() and not s.getLen() and not s.getPath().getName().startswith(("_", "."))]


def checked(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """file, bytes, sha256, status, kind, width, height of the files at a path.

    status: too_small (under `least` bytes), undecodable, truncated, invalid, wrong_suffix (a whole image of another kind than
    its name says), or valid.
    """
    ship(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [inspect(c) for c in batch.column("content").to_pylist()]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "bytes", "sha256")), *(pa.array([s[i] for s in seen], t) for i, t in enumerate(kinds))], ["file", "bytes", "sha256", "found", "kind", "width", "height"])

    held = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")
    seen = held.mapInArrow(look, "file string, bytes long, sha256 string, found string, kind string, width long, height long")
    named = F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)$", 1))
    fits = F.coalesce(*(F.when(F.col("kind") == k, named.isin(s)) for k, s in SUFFIXES.items()), F.lit(True))
    status = F.when(F.col("bytes") < least, "too_small").when((F.col("found") == "valid") & ~fits, "wrong_suffix").otherwise(F.col("found"))
    rows = seen.select("file", "bytes", "sha256", status.alias("status"), "kind", "width", "height")
    nothing = spark.createDataFrame([(n,) for n in _empty(spark, path)], "file string")
    status_of_none = F.lit("too_small" if least > 0 else "undecodable")
    none = F.lit(None)
    return rows.unionByName(nothing.select("file", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"), status_of_none.alias("status"), none.cast("string").alias("kind"), none.cast("long").alias("width"), none.cast("long").alias("height")))
