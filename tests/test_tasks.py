"""Tasks of preparation and products stay as large as they are when the graph grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import blocks, hubs, linalg, prepare
from weftgraph.plans import train as T

from .test_scale import ADJ, close, dense, features, graph, shuffled  # noqa: F401


def test_edges_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(prepare, "TASK_ROWS", 50)
    pairs = spark.range(2000).select((F.col("id") % 40).alias("src"), (F.col("id") % 37).alias("dst"))
    edges = prepare.symmetric(pairs)
    assert edges.rdd.getNumPartitions() == 40
    want = {(a % 40, a % 37) for a in range(2000)}
    want = {p for a, b in want if a != b for p in ((a, b), (b, a))}
    assert sorted(map(tuple, edges.collect())) == sorted(want)


@pytest.mark.parametrize("kind,parts", [("1d", 4), ("15d", 8), ("2d", 9), ("3d", 8)])
def test_large_cells_are_split(spark, shuffled, monkeypatch, kind, parts):  # noqa: F811
    monkeypatch.setattr(blocks, "BUCKET_EDGES", 400)
    rng = np.random.default_rng(3)
    adj = spark.createDataFrame([(int(s), int(d), float(w)) for (s, d), w in zip(rng.integers(0, 60, (9000, 2)), rng.random(9000), strict=True)], ADJ)
    h = features(spark, rng.random((60, 2)))
    stored = blocks.store_blocks(adj, blocks.layout(kind, 60, parts), 9000)
    assert stored.split > 1 and max(r["count"] for r in stored.table.groupBy("cell").count().collect()) < 9000 / parts
    for turned in (False, True):
        want = {r.node_id: r.x for r in linalg.spmm(prepare.transpose(adj) if turned else adj, h, 2).collect()}
        got = {r.node_id: r.x for r in blocks.spmm(stored, h, 2, turned).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_products_are_sent_packed(spark, shuffled, monkeypatch):  # noqa: F811
    monkeypatch.setattr(hubs, "PACKED", 7)
    monkeypatch.setattr(hubs, "TASK_PRODUCTS", 20)
    rng = np.random.default_rng(4)
    a, b = (rng.random((30, 30)) * (rng.random((30, 30)) < 0.3) for _ in "ab")
    a[3], b[5] = 1.0, 2.0
    frame = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], ADJ)
    out = hubs.multiply(frame(a), frame(b), 50)
    rows = out.collect()
    assert len(rows) == len({(r.src, r.dst) for r in rows}) and np.allclose(dense(out, 30), a @ b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(src") > plan.index("Generate inline")  # products are made behind the shuffle


def test_training_reads_edges_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BUCKET_EDGES", 20)
    whole, stored = graph(spark), graph(spark, block_edges=10)
    assert whole.stored is None and stored.stored.split > 1
    assert close(T.train(whole, 2)[-1], T.train(stored, 2)[-1])
    before = set(stored.tables.manifest)
    assert not any(name.startswith("product") for name in before)
    w1, w2 = T.train(whole, 1)[-1]
    got = {(r.layer, r.i, r.j): r.w for r in T.table_steps(stored, 1).collect()}
    assert all(np.isclose(got[k, i, j], v) for k, w in ((1, w1), (2, w2)) for i, row in enumerate(w) for j, v in enumerate(row))
    assert {name.split("-")[0] for name in set(stored.tables.manifest) - before} == {"state"}
