"""Acceptance gates: one row of metrics against a table of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check(metrics: DataFrame, gates: list[tuple[str, str, float]]) -> DataFrame:
    """(gate, operator, threshold, value, passed); `metrics` is one row, its columns the gates' names."""
    rows = [F.struct(F.lit(g).alias("gate"), F.lit(op).alias("operator"), F.lit(float(x)).alias("threshold"), F.round(F.col(g).cast("double"), 6).alias("value"), (F.col(g) >= x if op == ">=" else F.col(g) <= x).alias("passed")) for g, op, x in gates]
    return metrics.select(F.inline(F.array(*rows)))
