"""Degrees of a graph whose edges arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame) -> DataFrame:
    """node_id, d of a streaming (or batch) edge table, self loops and repeats counted; for update or complete output."""
    return edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
