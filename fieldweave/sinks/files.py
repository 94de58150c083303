"""Writers: stage files as CSV and JSON lines, checkpoints by record, lookup caches, sanitised copies, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ledger import resumed


def csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV parts with a header; structs, maps and arrays as JSON; nulls as blanks."""
    nested = [f.name for f in rows.schema if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType))]
    rows.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    """A folder of files with one record a line; later runs append."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def stages(frames: dict[str, DataFrame], folder: str, prefix: str = "") -> dict[str, str]:
    """Every stage as a CSV folder, also under the prefix if there is one; name -> path."""
    out = {}
    for name, rows in frames.items():
        for at in {name, f"{prefix}{name}"}:
            csv(rows, f"{folder}/{at}.csv")
            out[at] = f"{folder}/{at}.csv"
    return out


def checkpointed(spark: SparkSession, asked: DataFrame, path: str, key: str, work) -> DataFrame:
    """What `work` gives for the asked rows; those whose key a former run has written aren't done again (see ledger.resumed)."""
    return resumed(spark, asked, path, [key], work)


def cached(spark: SparkSession, asked: DataFrame, path: str, key: str, look_up) -> DataFrame:
    """Answers by key: from the cache at `path` where it has them, else from `look_up`, which then are in the cache too."""
    return asked.select(key).distinct().join(checkpointed(spark, asked.select(key).distinct(), path, key, look_up), key)


def sanitised(rows: DataFrame, keep_prefixes: list[str], drop_keys: list[str], json_column: str) -> DataFrame:
    """Only columns with one of the prefixes, and the JSON column without some keys."""
    kept = [c for c in rows.columns if c != json_column and any(c.startswith(p) for p in keep_prefixes)]
    pairs = F.map_filter(F.from_json(json_column, "map<string,string>"), lambda k, _: ~k.isin(drop_keys))
    return rows.select(*kept, F.to_json(pairs).alias(json_column))


def require(spark: SparkSession, paths: list[str]) -> None:
    """An error that names the files which aren't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    missing = [p for p in paths if not path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))]
    if missing:
        raise FileNotFoundError(", ".join(missing))


def markdown(rows: DataFrame, title: str, most: int = 50) -> str:
    """A report table of at most `most` rows; the rest is counted, not shown."""
    shown = rows.limit(most + 1).collect()
    line = lambda cells: "| " + " | ".join("" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ") for x in cells) + " |"
    body = [line(rows.columns), line("---" for _ in rows.columns), *(line(r) for r in shown[:most])]
    return "\n".join([f"## {title}", "", *body, *(["", f"Only the first {most} rows."] if len(shown) > most else [])]) + "\n"


def report(tables: dict[str, DataFrame], path: str, spark: SparkSession) -> None:
    """A Markdown report of small tables, written as one text file through Spark."""
    text = "\n".join(markdown(rows, title) for title, rows in tables.items())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
