"""Sparse and dense products. Dense matrices are (node_id, x) with x an array, or long (node_id, f, v)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(m: DataFrame, value: str = "v", index: str = "f") -> DataFrame:
    return m.select("node_id", F.posexplode("x").alias(index, value))


def summed(rows: DataFrame, keys: list, width: int) -> DataFrame:
    """Sums w * x of rows (keys, w, x) by keys, element by element: one row a key and task goes through the shuffle."""
    sums = rows.groupBy(*keys).agg(*(F.sum(F.col("w") * F.col("x")[k]).alias(f"s{k}") for k in range(width)))
    return sums.select(*keys, F.array(*(f"s{k}" for k in range(width))).alias("x"))


def spmm(adj: DataFrame, h: DataFrame, width: int) -> DataFrame:
    """(node_id, x): for each dst the sum of w times the source's row. Spark picks a broadcast or a shuffle join."""
    rows = adj.join(h.select(F.col("node_id").alias("src"), "x"), "src").select(F.col("dst").alias("node_id"), "w", "x")
    return summed(rows, ["node_id"], width)


def node_transform(h: DataFrame, w: list[list[float]]) -> DataFrame:
    """(node_id, x W). The weights are a few thousand numbers at most and travel as one broadcast row."""
    columns = [[float(row[j]) for row in w] for j in range(len(w[0]))]
    one = h.sparkSession.createDataFrame([(columns,)], "w array<array<double>>")
    dot = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return h.crossJoin(F.broadcast(one)).withColumn("x", F.transform("w", dot)).drop("w")


def transform_by_table(h: DataFrame, w: DataFrame, width: int) -> DataFrame:
    """(node_id, x W) with W a table (i, row): each feature meets its row of the weights, and a node's products are summed."""
    rows = h.select("node_id", F.posexplode("x").alias("i", "w")).join(w.withColumnRenamed("row", "x"), "i")
    return summed(rows.select("node_id", "w", "x"), ["node_id"], width)


def gram(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v): the transpose of a times b, rows matched by node_id. Each task sends one matrix, so no row is made for a product."""
    both = a.select("node_id", F.col("x").alias("a")).join(b.select("node_id", F.col("x").alias("b")), "node_id").select("a", "b")

    def partial(batches):
        total = None
        for batch in batches:
            x, y = (np.vstack(batch.column(k).to_numpy(zero_copy_only=False)) if batch.num_rows else None for k in (0, 1))
            if x is not None:
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    return both.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
