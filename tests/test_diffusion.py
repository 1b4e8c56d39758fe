"""The whole personalised PageRank against an inverse."""

import numpy as np
import pytest

from weftgraph.operators import diffusion, prepare
from weftgraph.plans import catalog
from weftgraph.sources import graphs

D = "/root/testdata/sf0.001"


def inverse_top(edges, n, alpha, k):
    """{(src, dst): share} of the normalised graph with self loops."""
    a = np.eye(n)
    for i, j in edges:
        a[i, j] = a[j, i] = 1
    root = 1 / np.sqrt(a.sum(axis=0))
    x = alpha * np.linalg.inv(np.eye(n) - (1 - alpha) * root[:, None] * a * root)
    x[np.abs(x) < 1e-15] = 0
    out = {}
    for c in range(n):
        rows = [i for i in np.lexsort((np.arange(n), -np.round(x[:, c], 12)))[:k] if x[i, c] > 0]
        out |= {(int(i), c): x[i, c] / x[rows, c].sum() for i in rows}
    return out


def top(spark, edges, n, k, gap=1, first=0):
    ids = spark.createDataFrame([(i * gap + first,) for i in range(n)], "node_id long")
    edges = spark.createDataFrame([(i * gap + first, j * gap + first) for i, j in edges], "src long, dst long")
    edges = prepare.with_self_loops(prepare.symmetric(edges), ids)
    return {((r.src - first) // gap, (r.dst - first) // gap): r.w for r in diffusion.pagerank_top(prepare.normalised(edges, ids), ids, 0.05, k).collect()}


@pytest.mark.parametrize("held,tile,numbers", [(5_000_000, 2048, 2_000_000), (40, 16, 800)])
@pytest.mark.parametrize("share", [0.03, 0.2])
def test_columns_are_those_of_the_inverse(spark, monkeypatch, held, tile, numbers, share):
    for name, value in (("HELD", held), ("TILE", tile), ("NUMBERS", numbers)):
        monkeypatch.setattr(diffusion, name, value)
    rng = np.random.default_rng(1)
    n = 40  # the last five nodes have no edges; ids have gaps
    edges = [(int(i), int(j)) for i, j in zip(*np.nonzero(rng.random((35, 35)) < share), strict=True) if i < j]
    got, want = top(spark, edges, n, 9, gap=3, first=5), inverse_top(edges, n, 0.05, 9)
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x]) for x in want)


def test_long_paths_are_followed_to_their_end(spark):
    """One step, or a few, reach the next nodes only."""
    n = 60
    got, want = top(spark, [(i, i + 1) for i in range(n - 1)], n, 50), inverse_top([(i, i + 1) for i in range(n - 1)], n, 0.05, 50)
    assert got.keys() == want.keys() and all(np.isclose(got[x], want[x]) for x in want)


def test_query_goes_on_behind_the_neighbours(spark):
    """Columns have about 23 neighbours here, so one step can't fill them; the values are held against SQL in test_queries."""
    rows = catalog.QUERIES["ppr_topk"](spark, D).groupBy("dst").count().collect()
    assert len(rows) == graphs.node_count(spark, D) and {r["count"] for r in rows} == {128}


def test_other_matrices_are_refused():
    i, j, w = np.array([0, 1, 1], np.int32), np.array([1, 0, 1], np.int32), np.array([5.0, 5.0, 1.0])
    with pytest.raises(ArithmeticError):
        diffusion.columns(lambda: [(i, j, w)], 2, np.arange(2), 0.05)
