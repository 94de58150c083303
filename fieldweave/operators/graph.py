"""Nodes and edges of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as R
from ..functions import text as T


def edges(rows: DataFrame, source: tuple[str, Column], relation: str, target: tuple[str, Column]) -> DataFrame:
    """Distinct edges between the nodes of two values of a row; rows where either is blank have none."""
    held = rows.filter((T.clean(source[1].cast("string")) != "") & (T.clean(target[1].cast("string")) != ""))
    node = lambda kind, name: R.node_id(kind, name.cast("string"))
    return held.select(node(*source).alias("source"), F.lit(relation).alias("relation"), node(*target).alias("target")).distinct()
