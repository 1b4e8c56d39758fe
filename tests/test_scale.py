"""What has to hold at scale: hubs don't meet in one task, stored blocks stay where they are, states stay small, runs go on and clean up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import blocks, hubs, linalg, prepare
from weftgraph.plans import train as T
from weftgraph.sources import graphs, npz, store

ADJ = "src long, dst long, w double"


def features(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, x array<double>")


def dense(adj, n, value="w"):
    m = np.zeros((n, n))
    for r in adj.collect():
        m[r.src, r.dst] += r[value]
    return m


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, in 16 tasks that aren't put together."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def star(spark, n=3000):
    """A third of all edges leave node 0, another third node 1; the rest is a ring."""
    rng = np.random.default_rng(1)
    pairs = [(0, i, 1.0) for i in range(n)] + [(1, i, 2.0) for i in range(n)] + [(i, (i + 1) % n, float(rng.random())) for i in range(n)]
    return spark.createDataFrame(pairs, ADJ).repartition(8)


def task_rows(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_hub_edges_are_dealt_out(spark, shuffled):
    adj, h = star(spark), features(spark, np.arange(6000).reshape(3000, 2) / 7)
    plain = adj.join(h.select(F.col("node_id").alias("src"), "x"), "src")
    assert max(task_rows(plain)) > 3000
    heavy = hubs.heavy_keys(adj, "src", 20)
    assert {r.src: r.parts for r in heavy.collect()} == {0: 151, 1: 151}
    split = hubs.with_part(adj, "src", heavy, ["dst"])
    rows = task_rows(hubs.joined(split, h, heavy))
    assert sum(rows) == 9000 and max(rows) <= 2 * np.median(rows)
    want = {r.node_id: r.x for r in linalg.spmm(adj, h, 2).collect()}
    got = {r.node_id: r.x for r in hubs.spmm(split, h, 2, heavy).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_heavy_keys_are_bounded_in_number(spark, monkeypatch):
    monkeypatch.setattr(hubs, "MOST_HEAVY", 10)
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"))
    assert hubs.heavy_keys(rows, "k", 1).count() == 0  # the bound was raised to 100 rows
    assert hubs.heavy_keys(rows.unionByName(spark.range(900).select(F.lit(5).cast("long").alias("k"))), "k", 1).count() == 1
    assert hubs.heavy_keys(rows.limit(0), "k", 1).count() == 0


def test_sparse_products_of_hubs(spark, shuffled):
    n = 60
    rng = np.random.default_rng(3)
    a, b = rng.random((n, n)) * (rng.random((n, n)) < 0.05), rng.random((n, n)) * (rng.random((n, n)) < 0.05)
    a[:, 7] = b[7, :] = 1.0
    a[:, 9], b[3, :] = 2.0, 1.0
    frame = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], ADJ)
    for bound in (1, 50, 10**9):
        assert np.allclose(dense(hubs.multiply(frame(a), frame(b), bound), n), a @ b)
    assert np.allclose(dense(prepare.multiply(frame(a), frame(b)), n), a @ b)


def nodes_of(plan, out=None):
    """All operators of an executed plan."""
    out = [] if out is None else out
    out.append(plan)
    children = plan.children()
    for i in range(children.size()):
        nodes_of(children.apply(i), out)
    return out


def exchanged(df):
    """(bytes that exchanges have moved, whether one is above a bucketed scan) after running a frame."""
    df.write.format("noop").mode("overwrite").save()
    query = df._jdf.queryExecution()
    plan = query.executedPlan()
    moved, over = 0, False
    plan.execute().count()
    for node in nodes_of(plan):
        if "Exchange" in node.nodeName():
            moved += node.metrics().apply("dataSize").value()
            over = over or any("Bucketed: true" in n.verboseStringWithOperatorId() for n in nodes_of(node) if "Scan" in n.nodeName() and not any("Aggregate" in m.nodeName() for m in nodes_of(node)))
    return moved, over


@pytest.mark.parametrize("kind,parts", [("1d", 4), ("15d", 8), ("2d", 9), ("3d", 8)])
def test_stored_edges_are_not_moved(spark, shuffled, kind, parts):
    rng = np.random.default_rng(2)
    n = 400
    adj = spark.createDataFrame([(int(s), int(d), 1.0) for s, d in rng.integers(0, n, (30_000, 2))], ADJ)
    h = features(spark, rng.random((n, 3)))
    stored = blocks.store_blocks(adj, blocks.layout(kind, n, parts))
    cells = stored.table.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("cell").alias("cells")).collect()
    assert len(cells) == stored.table.select("cell").distinct().count() and {r.cells for r in cells} == {1}  # a bucket is a cell
    with store.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        moved, over = exchanged(blocks.partial_sums(stored, h, 3))
    plain, _ = exchanged(linalg.spmm(adj, h, 3))
    assert not over and moved < plain / 2


def test_names_of_buckets(spark):
    names = blocks.bucket_names(spark, 13)
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(names)], "cell int, name int")
    assert all(r.cell == r.b for r in frame.select("cell", F.pmod(F.hash("name"), F.lit(13)).alias("b")).collect())


def test_pushed_residuals(spark):
    rng = np.random.default_rng(4)
    n, alpha = 40, 0.2
    pairs = [(0, i) for i in range(1, n)] + [tuple(map(int, p)) for p in rng.integers(0, n - 1, (60, 2)) if p[0] != p[1]]
    ids = spark.range(n).withColumnRenamed("id", "node_id")
    edges = prepare.with_self_loops(prepare.symmetric(spark.createDataFrame(pairs, "src long, dst long")), ids)
    adj, degree = prepare.normalised(edges, ids), prepare.degrees(edges, ids)
    d = np.array([r.d for r in degree.orderBy("node_id").collect()])
    exact = alpha * np.linalg.inv(np.eye(n) - (1 - alpha) * dense(adj, n))
    for eps in (1e-2, 1e-3):
        state = prepare.push_pagerank(adj, ids, degree, alpha, eps)
        low = exact - dense(state, n, "p")
        assert low.min() > -1e-12 and (low <= eps * np.sqrt(np.outer(d, d)) + 1e-12).all()
        assert state.count() <= n / (alpha * eps)
        assert state.where(f"r > {eps} * 60").count() == 0
    step = prepare.push_pagerank(adj, ids, degree, alpha, 1e-9, steps=1)
    assert np.allclose(dense(step, n, "r"), (1 - alpha) * dense(adj, n)) and np.allclose(dense(step, n, "p"), alpha * np.eye(n))
    # what is kept is deleted as soon as the next round is there
    assert len([f for f in store.folders(spark, state.inputFiles()[0].rsplit("/", 2)[0]) if f.startswith("state")]) == 1


def test_packed_arrays(spark, tmp_path):
    rng = np.random.default_rng(6)
    n = 1003
    x, y, kind = rng.random((n, 5)).astype(np.float32), rng.integers(0, 9, n), rng.integers(0, 5, n).astype(np.int8)
    row, col = rng.integers(0, n, 4000).astype(np.int32), rng.integers(0, n, 4000).astype(np.int32)
    order = np.lexsort((col, row))
    row, col = row[order], col[order]
    ptr = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    spark.dataSource.register(npz.NpzDataSource)
    twin = sorted((i, [float(v) for v in x[i]], int(y[i]), {1: "train", 2: "val", 3: "test"}.get(int(kind[i]))) for i in range(n))
    for k, save in enumerate((np.savez, np.savez_compressed)):
        data, coo, csr = (str(tmp_path / f"{name}{k}.npz") for name in ("data", "coo", "csr"))
        save(data, feature=x, label=y, node_types=kind)
        save(coo, row=row, col=col, data=np.ones(4000), shape=np.array([n, n]), format=np.array(b"coo"))
        save(csr, indptr=ptr, indices=col, data=np.arange(4000), shape=np.array([n, n]), format=np.array(b"csr"))
        nodes, edges = npz.read_packed_graph(spark, data, coo, rows=97)
        assert nodes.rdd.getNumPartitions() == 11
        nodes.write.mode("overwrite").parquet(str(tmp_path / "twin"))  # a Parquet twin has the same rows
        for df in (nodes, spark.read.parquet(str(tmp_path / "twin"))):
            assert sorted((r.node_id, r.x, r.y, r.split) for r in df.collect()) == twin
        assert sorted(map(tuple, edges.collect())) == sorted(set(zip(row.tolist(), col.tolist(), strict=True)))
        rows = spark.read.format("npz").option("sparse", "true").option("rows", "333").option("batch", "50").load(csr)
        assert sorted(map(tuple, rows.collect())) == sorted(zip(row.tolist(), col.tolist(), map(float, range(4000)), strict=True))
    assert spark.read.format("npz").option("arrays", "label").load(data).columns == ["row", "label"]
    # a folder's files follow each other
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        np.savez(folder / f"{k}.npz", a=np.arange(k * 4, k * 4 + 4), b=np.zeros((4, 0)))
    assert sorted((r.row, r.a) for r in spark.read.format("npz").load(str(folder)).collect()) == [(i, i) for i in range(12)]
    np.savez(tmp_path / "odd.npz", a=np.array(["x"]), b=np.zeros((2, 2)))
    for arrays in ("a", "missing"):
        with pytest.raises(Exception, match="can't be read|no arrays"):
            spark.read.format("npz").option("arrays", arrays).load(str(tmp_path / "odd.npz")).collect()


def graph(spark, **options):
    rng = np.random.default_rng(5)
    n = 24
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, n, (60, 2))] + [(0, i) for i in range(1, n)]
    x, y = rng.standard_normal((n, 3)), rng.integers(0, 5, n)
    nodes = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), "train" if i % 3 else "val") for i in range(n)], "node_id long, x array<double>, y int, split string")
    config = T.TrainConfig(hidden=4, classes=5, features=3, **options)
    return T.prepared(nodes, prepare.symmetric(spark.createDataFrame(pairs, "src long, dst long")), n, config)


def close(a, b):
    return all(np.allclose(x, y, rtol=1e-9, atol=1e-11) for x, y in zip(a, b, strict=True))


def test_training_splits_hubs(spark, tmp_path):
    whole, split = graph(spark), graph(spark, hub_edges=5)
    assert whole.heavy is None and split.heavy.count() > 0 and split.adj.where("part > 0").count() > 0 and split.adj.where("back > 0").count() > 0
    last = T.train(whole, 2)[-1]
    assert close(last, T.train(split, 2)[-1])
    T.save(split, str(tmp_path))
    assert close(last, T.train(T.open_saved(spark, str(tmp_path), split.config), 2)[-1])


def test_killed_run_goes_on(spark, tmp_path):
    g, path = graph(spark), str(tmp_path / "state")
    want = T.train(g, 4)
    T.train(g, 2, path)
    assert T.saved_epochs(spark, path) == [1, 2]
    # an attempt that was killed while it wrote has no success mark
    spark.range(1).write.parquet(f"{path}/epoch=000003")
    (tmp_path / "state" / "epoch=000003" / "_SUCCESS").unlink()
    rest = T.train(g, 4, path)
    assert len(rest) == 3 and all(close(a, b) for a, b in zip(rest, want[2:], strict=True))
    assert T.saved_epochs(spark, path) == [3, 4] and T.read_state(spark, path, g.config)[2].t == 4
    assert len(T.train(g, 4, path)) == 1
    with pytest.raises(ValueError, match="other settings"):
        T.train(graph(spark, rate=0.5), 5, path)


def test_tables_of_a_run_go(spark):
    g = graph(spark, runs=2)
    before = set(g.tables.manifest)
    got = T.history(g, 3)
    assert got.count() == 12 and set(g.tables.manifest) == before
    assert set(store.folders(spark, g.tables.folder)) == before | {"history"}
    assert len(got.inputFiles()) <= 6 * 2
    g.tables.drop(got, spark.range(1))  # frames of other origin are left alone
    g.tables.close()
    assert store.folders(spark, g.tables.folder) == []
    with store.Tables(spark, "own") as own:
        t = own.put(spark.range(3), "t")
        assert t.count() == 3 and len(own.manifest) == 1
        own.drop(t)
        assert not own.manifest and store.folders(spark, own.folder) == []


def test_weights_as_tables(spark):
    g = graph(spark)
    w1, w2 = T.train(g, 3)[-1]
    before = set(g.tables.manifest)
    state = T.table_steps(g, 3)
    got = {(r.layer, r.i, r.j): r for r in state.collect()}
    assert len(got) == 3 * 4 + 4 * 5 and {r.t for r in got.values()} == {3}
    assert all(np.isclose(got[k, i, j].w, v) for k, w in ((1, w1), (2, w2)) for i, row in enumerate(w) for j, v in enumerate(row))
    assert len(set(g.tables.manifest) - before) == 1
    cold = spark.createDataFrame([(1, 0, 0, 1.0, 0.5, 0.25, 7)], T.STATE)
    none = T.adam_table(cold, spark.createDataFrame([], "layer int, i int, j int, g double"), 0.01).first()
    assert none.m == 0.45 and np.isclose(none.v, 0.24975) and none.t == 8


@pytest.mark.parametrize("blocks_,on", [(1, True), (3, True), (7, True), (3, False)])
def test_class_blocks_give_the_same_gradients(spark, blocks_, on):
    g = graph(spark, activations=on)
    rng = np.random.default_rng(9)
    w1, w2 = rng.standard_normal((3, 4)).tolist(), rng.standard_normal((4, 5)).tolist()
    want = T.gradients(g, w1, w2)
    got = T.blocked_gradients(g, w1, w2, blocks_)
    for a, b in zip(want[:2], got[:2], strict=True):
        a, b = ({(r.i, r.j): r.v for r in x.collect()} for x in (a, b))
        assert a.keys() == b.keys() and all(np.isclose(a[k], b[k], atol=1e-12) for k in a)
    assert got[2].select(F.max(F.size("x"))).first()[0] == -(-5 // blocks_)
    loss = {r.split: r.loss for r in T.losses(g, want[2]).groupBy("split").agg(F.avg("loss").alias("loss")).collect()}
    assert all(np.isclose(r.loss, loss[r.split]) for r in T.blocked_loss(g, got[2]).collect())


def test_loss_of_one_node_of_large_scores(spark):
    z = spark.createDataFrame([(0, [1000.0, 999.0]), (0, [-1000.0]), (1, [-800.0]), (1, [-800.0])], "node_id long, x array<double>")
    from weftgraph.functions import neural

    got = {r.node_id: r.norm for r in neural.log_norm(z).collect()}
    assert np.isclose(got[0], 1000 + np.log1p(np.exp(-1))) and np.isclose(got[1], -800 + np.log(2))


def test_start_tables_are_the_start(spark):
    g = graph(spark)
    w1, w2 = T.start(g.config)
    assert all(np.isclose(r.w, (w1, w2)[r.layer - 1][r.i][r.j]) for r in T.start_table(g).collect())
    assert graphs.uniform_number(0, 0, 1) == w1[0][0]
