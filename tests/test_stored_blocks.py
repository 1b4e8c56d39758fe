"""Sparse products of stored blocks: nothing is shuffled for a product, and results are those of the join."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import grid, prepare
from weftgraph.plans import catalog

from .test_grid import ADJ, frame

D = "/root/testdata/sf0.001"


def joined(a, b):
    b = b.select(F.col("src").alias("k"), F.col("dst").alias("c"), F.col("w").alias("v"))
    rows = a.join(b, F.col("dst") == F.col("k")).groupBy("src", "c").agg(F.sum(F.col("w") * F.col("v"))).collect()
    return {tuple(r[:2]): r[2] for r in rows}


def same(out, want):
    rows = out.collect()
    got = {(r.src, r.dst): r.w for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("share,sent", [(0.05, 0), (0.6, 0)])
def test_products_of_stored_blocks(spark, monkeypatch, share, sent):
    monkeypatch.setattr(grid, "SENT", sent)
    monkeypatch.setattr(grid, "BLOCK", 300)
    monkeypatch.setattr(grid, "READ", 1000)
    rng = np.random.default_rng(5)
    a, b = (frame(spark, rng.standard_normal((40, 40)) * (rng.random((40, 40)) < share), 7) for _ in "ab")
    out = prepare.multiply(a, b)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    same(out, joined(a, b))


def test_rows_of_many_products_and_ids_far_apart():
    rng = np.random.default_rng(6)
    src, k, k2, c = (rng.integers(0, n, 400) for n in (5, 30, 30, 90))
    far = np.array([-(1 << 62), -1, 0, 1 << 62, (1 << 63) - 1])
    for names, columns in ((np.arange(5), np.arange(90)), (far, far[np.arange(90) % 5] + np.arange(90) % 2 * -1)):
        want = {}
        for s, i in zip(src, k, strict=True):
            for j, t in zip(k2, c, strict=True):
                if i == j:
                    want[names[s], columns[t]] = want.get((names[s], columns[t]), 0) + 1.0
        parts = list(grid.products((names[src], k, np.ones(400)), (k2, columns[c], np.ones(400)), 50))
        got = [(i, j, x) for p in parts for i, j, x in zip(*p, strict=True)]
        assert len(parts) > 5 and len(got) == len(want) and {(i, j): x for i, j, x in got} == want


def test_nulls_and_large_blocks_go_by_the_join(spark, monkeypatch):
    rows = [(1, 2, 1.0), (None, 2, 2.0), (3, None, 1.0), (2, 4, 3.0)]
    a, b = spark.createDataFrame(rows, ADJ), spark.createDataFrame([(2, 5, 1.0), (2, None, 1.0), (4, 5, 2.0)], ADJ)
    deal = lambda: (grid.by_block(a, "src", 2), grid.by_block(b, "dst", 1), 2, 1, 10)
    want = joined(a, b)
    same(prepare.multiply_dealt(*deal()), want)
    monkeypatch.setattr(grid, "BLOCK", 0)
    same(prepare.multiply_dealt(*(x.where("src IS NOT NULL AND dst IS NOT NULL") if hasattr(x, "where") else x for x in deal())), {k: v for k, v in want.items() if None not in k})


def test_products_of_orders_and_suppliers_are_not_shuffled(spark):
    text = catalog.QUERIES["spspmm_hubs"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "HashAggregate" not in text


def test_pairs_are_sorted_before_they_are_sent(spark, monkeypatch):
    monkeypatch.setattr(prepare, "TASK_ROWS", 50)
    edges = spark.createDataFrame([(i % 5, (i * 7) % 6 - 1) for i in range(900)], "src long, dst long")
    want = sorted({p for i in range(900) for p in ((i % 5, (i * 7) % 6 - 1), ((i * 7) % 6 - 1, i % 5)) if p[0] != p[1]})
    assert sorted(map(tuple, prepare.symmetric(edges).collect())) == want
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, 3, 1 << 40]), pa.array([4, 2, 4, 1 << 41])], ["a", "b"])
    assert [b.to_pylist() for b in prepare.sorted_pairs([batch.slice(0, 3)])] == [[{"a": 1, "b": 2}, {"a": 3, "b": 4}]]
    assert sum(b.num_rows for b in prepare.sorted_pairs([batch, batch])) == 3
