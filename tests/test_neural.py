"""Row functions compute what they share once a row, not once an element."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import neural
from weftgraph.operators import prepare

WIDTH, ROWS = 200, 200


@pytest.mark.parametrize("name", ["softmax", "row sums"])
def test_work_grows_with_the_width(spark, name):
    nodes = spark.range(ROWS).select(F.col("id").alias("node_id"), F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), lambda k: F.sin(k + F.col("id"))).alias("x"))
    run = neural.log_softmax if name == "softmax" else prepare.row_normalised
    run(nodes.limit(1)).collect()
    begin = time.monotonic()
    got = {r.node_id: r.x for r in run(nodes).collect()}
    assert time.monotonic() - begin < 10  # 64 elements by 2,000 rows took 23 s with the sums inside the loop
    x = np.sin(np.arange(1, WIDTH + 1) + 7)
    want = x - x.max() - np.log(np.exp(x - x.max()).sum()) if name == "softmax" else x / max(x.sum(), 1)
    assert np.allclose(got[7], want, rtol=1e-12)
