"""Gives the package to the Python workers of a session, as spark-submit --py-files would."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session; workers import what functions of this package call."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    top = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fieldweave-")), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(at, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(at)
