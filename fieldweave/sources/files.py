"""Readers: text-typed CSV, JSON lines, parquet tables, members of archives, images and stage files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean
from ..operators.splits import stratified

# First bytes of image files by suffix, and suffixes that stay in names.
MAGIC = {"jpg": b"\xff\xd8\xff", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF8", "webp": b"RIFF", "tif": b"II*\x00", "tiff": b"II*\x00"}
SUFFIXES = ["jpg", "jpeg", "png", "tif", "tiff", "webp"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt to tasks by key, before long work on each: one split of a Parquet file holds millions of narrow rows."""
    return rows.repartition(F.col(key))


def records(spark: SparkSession, path: str, required: list[str], key: str | None = None) -> DataFrame:
    """A CSV of strings, every cell clean; blanks for required columns that it lacks; new keys for all rows if any key is blank.

    New keys are "record-" and a digest of the row, so they don't depend on the order of reading.
    """
    found = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    cells = found.select(*(clean(F.col(f"`{c}`")).alias(c) for c in found.columns), *(F.lit("").alias(c) for c in required if c not in found.columns))
    if key is None or cells.filter(F.col(key) == "").isEmpty():
        return cells
    return cells.withColumn(key, F.concat(F.lit("record-"), F.substring(F.sha2(F.to_json(F.struct(*[c for c in cells.columns if c != key])), 256), 1, 16)))


def with_images(rows: DataFrame, image: str, ids: list[str], key: str, keep: list[str]) -> DataFrame:
    """Rows that have an image; the key is the first id that isn't blank, or a digest of the image; only the columns to keep."""
    held = rows.filter(clean(F.col(image)) != "")
    first = F.coalesce(*(F.nullif(clean(F.col(c)), F.lit("")) for c in ids if c in rows.columns), F.concat(F.lit("image-"), F.substring(F.sha2(F.col(image), 256), 1, 16)))
    return held.withColumn(key, first).select(key, *[c for c in keep if c in rows.columns and c != key])


def aliased(rows: DataFrame, aliases: dict[str, list[str]], core: list[str], least: int, image: str) -> DataFrame:
    """Columns under their usual names (exact names before parts of names); rows with `least` core fields and an image."""
    found: dict[str, str] = {}
    for name, others in aliases.items():
        exact = [c for c in rows.columns for o in others if c.lower() == o.lower()]
        partly = [c for c in rows.columns for o in others if o.lower() in c.lower()]
        if exact or partly:
            found[name] = (exact or partly)[0]
    named = rows.select(*((clean(F.col(found[n])) if n in found else F.lit("")).alias(n) for n in aliases))
    filled = reduce(lambda a, b: a + b, [(F.col(c) != "").cast("int") for c in core])
    return named.filter((filled >= least) & (F.col(image) != ""))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One record a line; blank lines are none."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("r")).select("r.*")


def stage_or(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stage's folder if it was written before (text-typed where its name ends in .csv, else Parquet), else what `compute` gives."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not held.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        return compute()
    return records(spark, path, []) if path.endswith(".csv") else spark.read.parquet(path)


def splits(spark: SparkSession, paths: dict[str, str], key: str) -> DataFrame:
    """Frozen splits as one frame with their names; an error if two splits share a key."""
    parts = [records(spark, path, [key]).withColumn("split", F.lit(name)) for name, path in paths.items()]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    shared = [r[0] for r in both.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").select(key).limit(5).collect()]
    if shared:
        raise ValueError(f"splits share {sorted(shared)}")
    return both


def frozen(spark: SparkSession, paths: dict[str, str], key: str, stratum: str, sizes: dict[str, int], seed: int) -> tuple[DataFrame, DataFrame]:
    """Frozen splits, those with a smaller size drawn down in proportion to their strata, and (split, stratum, n) of what is left.

    Rows of a blank stratum are a stratum of their own; an error if two splits share a key.
    """
    whole = splits(spark, paths, key)
    parts = []
    for i, name in enumerate(paths):
        own = whole.filter(F.col("split") == name)
        if name in sizes:
            drawn = stratified(own, key, stratum, sizes[name], seed + i)
            own = own.join(drawn.select(key).distinct(), key, "left_semi")
        parts.append(own)
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows, rows.groupBy("split", F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))


def by_family(spark: SparkSession, folder: str, families: list[str], suffix: str = "_outputs.jsonl") -> DataFrame:
    """Lines of the files of the first family that has any, with their file; of any family if none has."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    lines = lines.filter(F.col("file").endswith(suffix) & (F.trim("value") != ""))
    rank = F.coalesce(*(F.when(F.col("file").startswith(f"{f}_"), i) for i, f in enumerate(families)), F.lit(len(families)))
    ranked = lines.withColumn("rank", rank)
    return ranked.join(F.broadcast(ranked.agg(F.min("rank").alias("rank"))), "rank").drop("rank")  # one row


def zip_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(archive, member, content) of the members whose name ends in suffix; archives are opened where they are read."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as held:
                    for member in held.namelist():
                        if member.endswith(suffix):
                            yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]]), pa.array([member]), pa.array([held.read(member)], pa.binary())], ["archive", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(members, "archive string, member string, content binary")


def zip_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of all .jsonl members, with archive and member."""
    lines = zip_members(spark, path, ".jsonl").select("archive", "member", F.explode(F.split(F.col("content").cast("string"), r"\r?\n")).alias("line")).filter("trim(line) <> ''")
    return lines.select("archive", "member", F.from_json("line", schema).alias("r")).select("archive", "member", "r.*")


def images(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """(file, bytes, sha256, status) of image files: too_small, undecodable by their first bytes, or valid."""
    held = spark.read.format("binaryFile").load(path)
    known = reduce(lambda a, b: a | b, [F.startswith("content", F.lit(bytearray(m))) for m in MAGIC.values()])
    status = F.when(F.col("length") < least, "too_small").when(~known, "undecodable").otherwise("valid")
    return held.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), status.alias("status"))


def safe_name(c: Column) -> Column:
    """Only letters, digits, - _ and . stay; no dot or underscore at an end."""
    return F.regexp_replace(F.regexp_replace(clean(c), r"[^A-Za-z0-9\-_.]+", "_"), r"^[._]+|[._]+$", "")


def suffix_of(url: Column) -> Column:
    """The suffix of a URL's path if it is an image's, else .jpg."""
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\.([A-Za-z]+)(?:[?#].*)?$", 1))
    return F.when(found.isin(SUFFIXES), F.concat(F.lit("."), found)).otherwise(".jpg")
