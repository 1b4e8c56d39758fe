"""Sparse products in a grid."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import grid, prepare

ADJ = "src long, dst long, w double"


def frame(spark, m, gap=1):
    return spark.createDataFrame([(int(i) * gap, int(j) * gap, float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], ADJ)


@pytest.mark.parametrize("share", [0.02, 0.7])
def test_products_in_a_grid(spark, share):
    rng = np.random.default_rng(2)
    a, b = (rng.standard_normal((50, 50)) * (rng.random((50, 50)) < share) for _ in "ab")
    there = (a != 0).astype(int) @ (b != 0).astype(int) > 0
    got = {(r.src // 7, r.dst // 7): r.w for r in grid.multiply(frame(spark, a, 7), frame(spark, b, 7), 3).collect()}
    assert got.keys() == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(there))), strict=True))
    assert all(np.isclose(w, (a @ b)[k]) for k, w in got.items())


def test_sums_of_zero_and_repeated_entries_stay():
    left = pa.table({"src": [1, 1, 1], "k": [5, 6, 6], "w": [1.0, 1.0, 2.0]})
    right = pa.table({"k": [5, 6, 9], "c": [3, 3, 4], "v": [-3.0, 1.0, 1.0]})
    assert grid.block_product(left, right).to_pylist() == [{"src": 1, "dst": 3, "w": 0.0}]
    assert grid.block_product(left.slice(0, 2), right).to_pylist() == [{"src": 1, "dst": 3, "w": -2.0}]
    assert grid.block_product(left.slice(0, 0), right).num_rows == 0


def test_dense_products_are_not_shuffled(spark):
    """A whole graph of n nodes has n^3 products; what its product moves are the entries of both factors, once for each side of the grid."""
    n = 120
    ids = spark.range(n).withColumnRenamed("id", "node_id")
    adj = ids.select(F.col("node_id").alias("src")).crossJoin(ids.select(F.col("node_id").alias("dst"))).withColumn("w", F.lit(1.0))
    assert grid.side(adj, adj) == 4 and grid.side(adj.limit(5), adj.limit(5)) is None
    out = prepare.multiply(adj, adj)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text and "HashAggregate" not in text
    assert out.where(f"w = {n}").count() == n * n
