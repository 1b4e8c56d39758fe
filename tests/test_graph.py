"""Hand-sized graphs, equivalence of the layouts, gradients against differences, training against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import neural
from weftgraph.operators import blocks, linalg, partition, prepare
from weftgraph.plans import train as T
from weftgraph.sources import graphs


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "node_id")


def dense(adj, n):
    m = np.zeros((n, n))
    for r in adj.collect():
        m[r.src, r.dst] += r.w
    return m


def features(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, x array<double>")


def rows(df, n):
    out = {r.node_id: r.x for r in df.collect()}
    return np.array([out[i] for i in range(n)])


def test_path_graph_is_normalised(spark):
    sym = prepare.symmetric(edges(spark, [(0, 1), (1, 2)]))
    full = prepare.with_self_loops(sym, ids(spark, 3))
    assert {r.node_id: r.d for r in prepare.degrees(full, ids(spark, 3)).collect()} == {0: 2, 1: 3, 2: 2}
    got = dense(prepare.normalised(full, ids(spark, 3)), 3)
    s = 1 / 6**0.5
    assert np.allclose(got, [[0.5, s, 0], [s, 1 / 3, s], [0, s, 0.5]])
    assert np.allclose(got, got.T)


def test_repeated_edges_sum_or_collapse(spark):
    e = edges(spark, [(0, 1)] * 3)
    assert [r.w for r in prepare.summed_edges(e).collect()] == [3]
    assert prepare.distinct_edges(e).count() == 1


def test_isolated_node_has_degree_and_weight_zero(spark):
    e = edges(spark, [(0, 1), (1, 0)])
    assert {r.node_id: r.d for r in prepare.degrees(e, ids(spark, 3)).collect()}[2] == 0
    assert spark.range(1).select(prepare.inverse_root(F.lit(0)).alias("r")).first().r == 0.0


def test_empty_edges(spark):
    e = edges(spark, [])
    assert prepare.normalised(e, ids(spark, 2)).count() == 0
    assert linalg.spmm(e.withColumn("w", F.lit(1.0)), features(spark, np.ones((2, 3))), 3).count() == 0


def test_ragged_blocks(spark):
    r = ids(spark, 10)
    ceil = r.groupBy(partition.ceil_block(F.col("node_id"), 10, 3)[0].alias("b")).count().collect()
    floor = r.groupBy(partition.floor_block(F.col("node_id"), 10, 3)[0].alias("b")).count().collect()
    assert sorted(x["count"] for x in ceil) == [2, 4, 4]
    assert sorted(x["count"] for x in floor) == [3, 3, 4]
    with pytest.raises(ValueError):
        partition.grid_side(6, 2)


@pytest.mark.parametrize("n,seed", [(11, 0), (5, 1)])
def test_layouts_agree_with_numpy(spark, n, seed):
    rng = np.random.default_rng(seed)
    a = (rng.random((n, n)) < 0.4) * rng.random((n, n))
    adj = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "src long, dst long, w double")
    x = rng.standard_normal((n, 4))
    h = features(spark, x)
    want = a.T @ x
    some = [i for i in range(n) if a[:, i].any()]
    lays = [blocks.layout("1d", n, 4), blocks.layout("15d", n, 8, 2), blocks.layout("15d", n, 4, 4), blocks.layout("2d", n, 9), blocks.layout("3d", n, 8)]
    for out in (linalg.spmm(adj, h, 4), *(blocks.spmm(blocks.store_blocks(adj, lay), h, 4) for lay in lays)):
        got = {r.node_id: r.x for r in out.collect()}
        assert sorted(got) == some
        assert np.allclose([got[i] for i in some], want[some])
    assert np.allclose(dense(prepare.multiply(adj, adj), n), a @ a)
    g = np.zeros((4, 4))
    for r in linalg.gram(h, h).collect():
        g[r.i, r.j] = r.v
    assert np.allclose(g, x.T @ x)


def test_rows_functions(spark):
    x = np.random.default_rng(3).standard_normal((6, 5)) * 4
    out = rows(neural.log_softmax(features(spark, x)), 6)
    assert np.allclose(np.exp(out).sum(axis=1), 1)
    top = {r.node_id: r.p for r in features(spark, [[1, 3, 3], [2, 2, 2]]).select("node_id", neural.argmax(F.col("x")).alias("p")).collect()}
    assert top == {0: 1, 1: 0}


def small_graph(spark, directed, activations):
    rng = np.random.default_rng(5)
    n = 6
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (2, 3), (5, 0)]
    e = edges(spark, pairs) if directed else prepare.symmetric(edges(spark, pairs))
    x, y = rng.standard_normal((n, 3)), rng.integers(0, 2, n)
    split = ["train", "train", "train", "train", "val", "test"]
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), split[i]) for i in range(n)], "node_id long, x array<double>, y int, split string")
    adj = prepare.normalised(prepare.with_self_loops(e, nodes), nodes)
    config = T.TrainConfig(hidden=4, classes=2, features=3, activations=activations)
    return T.Graph(nodes, adj.cache(), linalg.spmm(adj, nodes, 3).cache(), n, config), dense(adj, n), x, y, np.array([s == "train" for s in split])


def model(m, x, w1, w2, on):
    z1 = m.T @ x @ w1
    h1 = np.maximum(z1, 0) if on else z1
    z2 = m.T @ h1 @ w2
    return z2 - np.log(np.exp(z2 - z2.max(1, keepdims=True)).sum(1, keepdims=True)) - z2.max(1, keepdims=True) if on else z2


@pytest.mark.parametrize("directed,on", [(False, True), (True, True), (True, False)])
def test_gradients_match_differences(spark, directed, on):
    g, m, x, y, train = small_graph(spark, directed, on)
    rng = np.random.default_rng(1)
    w1, w2 = rng.standard_normal((3, 4)), rng.standard_normal((4, 2))
    loss = lambda a, b: -model(m, x, a, b, on)[np.arange(6), y][train].mean()
    got, _ = T.collect_gradients(g, w1.tolist(), w2.tolist())
    for layer, w in ((1, w1), (2, w2)):
        for i in range(w.shape[0]):
            for j in range(w.shape[1]):
                up, down = w.copy(), w.copy()
                up[i, j] += 1e-6
                down[i, j] -= 1e-6
                want = (loss(up, w2) - loss(down, w2) if layer == 1 else loss(w1, up) - loss(w1, down)) / 2e-6
                assert abs(got.get((layer, i, j), 0) - want) < 1e-6


def test_training_reduces_the_loss(spark):
    g, m, x, y, train = small_graph(spark, False, True)
    first, *_, last = T.train(g, 3)
    loss = lambda w: -model(m, x, np.array(w[0]), np.array(w[1]), True)[np.arange(6), y][train].mean()
    assert loss(last) < loss(first)
    assert np.isclose(first[0][1][2], graphs.uniform_number(1, 2, 1))


def test_loss_of_blocks(spark):
    g, m, x, y, train = small_graph(spark, True, True)
    g.config.loss_blocks = 3
    w1, w2 = np.random.default_rng(2).standard_normal((3, 4)), np.random.default_rng(3).standard_normal((4, 2))
    got, _ = T.collect_gradients(g, w1.tolist(), w2.tolist())
    def loss(b):
        own = -model(m, x, w1, b, True)[np.arange(6), y]
        return sum(own[i : i + 2][train[i : i + 2]].mean() for i in (0, 2))  # the third block has no training node

    for i in range(4):
        for j in range(2):
            up, down = w2.copy(), w2.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert abs(got[(2, i, j)] - (loss(up) - loss(down)) / 2e-6) < 1e-6


def test_a_users_graph(spark, tmp_path):
    nodes = spark.createDataFrame([(30, [1.0], 0, "train"), (10, [2.0], 1, "val"), (20, [3.0], 0, "train")], graphs.NODES)
    nodes.write.parquet(f"{tmp_path}/nodes")
    edges(spark, [(10, 30), (20, 10), (10, 30)]).write.csv(f"{tmp_path}/edges")
    n, e = graphs.read_graph(spark, f"{tmp_path}/nodes", f"{tmp_path}/edges", "csv")
    assert {r.node_id: r.x for r in n.collect()} == {0: [2.0], 1: [3.0], 2: [1.0]}
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 2), (0, 2), (1, 0)]
    for rows, pairs in (([(None, [1.0], 0, "a")], []), ([(0, [None], 0, "a")], []), ([(0, [1.0], 0, "a")] * 2, []), ([(0, [1.0], 0, "a")], [(0, 5)]), ([(0, [1.0], 0, "a")], [(None, 0)])):
        with pytest.raises(ValueError):
            graphs.checked_graph(spark.createDataFrame(rows, graphs.NODES), edges(spark, pairs))
    config = T.TrainConfig(hidden=2, classes=2, features=1, all_train=True, inward=False, runs=2)
    g = T.prepared(n, prepare.distinct_edges(e), 3, config)
    T.save(g, f"{tmp_path}/saved")
    first, again = (sorted(map(tuple, T.history(x, 2).collect())) for x in (g, T.open_saved(spark, f"{tmp_path}/saved", config)))
    assert first == again and len(first) == 4 and {r[0] for r in first} == {1, 2} and {r[2] for r in first} == {"train"}
