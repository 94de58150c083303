"""Where queries write what they read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share; in local mode without one (tests), in a temporary folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _OWN.setdefault("at", tempfile.mkdtemp(prefix="fieldweave-"))
    return f"{at}/fieldweave/{name}-{uuid.uuid4().hex}"
