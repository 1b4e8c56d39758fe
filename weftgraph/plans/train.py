"""Two-layer graph convolution: forward, backward, Adam and the training loop."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import neural
from ..operators import blocks, hubs, linalg, partition, prepare
from ..sources import graphs
from ..sources.store import Tables, exists, folders, remove, setting


@dataclass
class TrainConfig:
    """What a run does.

    ``activations`` off leaves both layers linear, ``normalise`` off sums plain neighbours,
    ``all_train`` trains on every node, ``inward`` off sums over a node's out-neighbours
    instead of its in-neighbours, ``runs`` repeats a run from the same start.
    ``loss_blocks`` of k > 0 takes the sum of the mean losses of k blocks of node ids
    instead of the mean of all. ``hub_edges`` is how many edges of one node a task of a product takes; a node with more is split into parts.
    A graph without such nodes but with more than ``block_edges`` edges is stored in a grid of buckets, so that products move no edge and a task adds up few nodes.
    """

    hidden: int = 16
    classes: int = 10
    features: int = 64
    epochs: int = 2
    rate: float = 0.01
    activations: bool = True
    normalise: bool = True
    loss_blocks: int = 0
    all_train: bool = False
    inward: bool = True
    runs: int = 1
    hub_edges: int = 1_000_000
    block_edges: int = 2_000_000


@dataclass
class Graph:
    """Prepared inputs: the weighted adjacency and, hoisted out of the loop, the aggregated features.

    ``adj`` has the part of each edge for products over sources (``part``) and over destinations (``back``); ``heavy`` and ``heavy_back`` are the nodes that are
    split, None where no node is (then there are no parts). ``tables`` has what the run writes; the caller may close it when nothing of the graph is read any more.
    """

    nodes: DataFrame
    adj: DataFrame
    mx: DataFrame
    n: int
    config: TrainConfig = field(default_factory=TrainConfig)
    heavy: DataFrame | None = None
    heavy_back: DataFrame | None = None
    tables: Tables | None = None
    stored: blocks.Blocks | None = None

    def __post_init__(self):
        self.tables = self.tables or Tables(self.nodes.sparkSession)

    def forward(self, h: DataFrame, width: int) -> DataFrame:
        """M h; an adjacency without parts is taken as it is, or from its buckets."""
        if self.stored:
            return self._product(h, width)
        if self.heavy is None:
            return linalg.spmm(self.adj, h, width)
        return hubs.spmm(self.adj.select("src", "dst", "w", "part"), h, width, self.heavy)

    def backward(self, h: DataFrame, width: int) -> DataFrame:
        """The transpose of M times h."""
        if self.stored:
            return self._product(h, width, True)
        if self.heavy_back is None:
            return linalg.spmm(prepare.transpose(self.adj), h, width)
        turned = self.adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.col("back").alias("part"))
        return hubs.spmm(turned, h, width, self.heavy_back)

    def _product(self, h: DataFrame, width: int, turned: bool = False) -> DataFrame:
        with setting(h.sparkSession, blocks.BY_CELL, "false"):
            return self.tables.put(blocks.partial_sums(self.stored, h, width, turned), "product")


def prepared(nodes: DataFrame, edges: DataFrame, n: int, config: TrainConfig) -> Graph:
    """A graph to train on from nodes and distinct edges: the adjacency and the aggregated features are written once."""
    if config.all_train:
        nodes = nodes.withColumn("split", F.lit("train"))
    edges = prepare.with_self_loops(edges, nodes)
    adj = prepare.normalised(edges, nodes) if config.normalise else edges.withColumn("w", F.lit(1.0))
    adj = adj if config.inward else prepare.transpose(adj)
    tables = Tables(nodes.sparkSession)
    adj, heavy, back = tables.put(adj, "adj"), None, None
    if adj.count() > config.hub_edges:  # else no node can have more
        plain = adj
        heavy = tables.put(hubs.heavy_keys(plain, "src", config.hub_edges), "heavy")
        back = tables.put(hubs.heavy_keys(plain, "dst", config.hub_edges).withColumnRenamed("dst", "src"), "heavy_back")
        if heavy.isEmpty() and back.isEmpty():
            tables.drop(heavy, back)
            heavy = back = None
        else:
            split = hubs.with_part(plain, "src", heavy, ["dst"]).withColumnRenamed("part", "_part")
            split = hubs.with_part(split, "dst", back.withColumnRenamed("src", "dst"), ["src"])
            adj = tables.put(split.select("src", "dst", "w", F.col("_part").alias("part"), F.col("part").alias("back")), "adj")
            tables.drop(plain)
    g = Graph(nodes, adj, nodes, n, config, heavy, back, tables)
    g.stored = in_buckets(g)
    before = set(tables.manifest)
    g.mx = tables.put(g.forward(nodes, config.features), "mx")
    tables.drop_named("product", set(tables.manifest) - before)
    return g


def in_buckets(g: Graph) -> blocks.Blocks | None:
    """The adjacency in a grid of buckets, if it has no parts and more than ``block_edges`` edges."""
    if g.heavy is not None or g.heavy_back is not None or (edges := g.adj.count()) <= g.config.block_edges:
        return None
    return blocks.store_blocks(g.adj, blocks.Layout(1, 1, lambda x: F.lit(0), lambda x: F.lit(0)), edges)


def load(spark: SparkSession, sf_dir: str, config: TrainConfig | None = None) -> Graph:
    """The graph of the test tables, see graphs.nodes and graphs.coo_edges."""
    edges = prepare.symmetric(graphs.coo_edges(spark, sf_dir))
    return prepared(graphs.nodes(spark, sf_dir), edges, graphs.node_count(spark, sf_dir), config or TrainConfig())


def save(g: Graph, path: str) -> None:
    """Writes a prepared graph, to be opened by a later session."""
    for name in ("nodes", "adj", "mx", "heavy", "heavy_back"):
        if (table := getattr(g, name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def open_saved(spark: SparkSession, path: str, config: TrainConfig | None = None) -> Graph:
    nodes, adj, mx = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "adj", "mx"))
    heavy, back = (spark.read.parquet(f"{path}/{name}") if "part" in adj.columns else None for name in ("heavy", "heavy_back"))
    g = Graph(nodes, adj, mx, nodes.count(), config or TrainConfig(), heavy, back)
    g.stored = in_buckets(g)
    return g


def layer1(g: Graph, w1) -> tuple[DataFrame, DataFrame]:
    """(z1, h1)"""
    z1 = linalg.node_transform(g.mx, w1)
    return z1, z1.withColumn("x", neural.relu("x")) if g.config.activations else z1


def layer2(g: Graph, h1: DataFrame, w2) -> DataFrame:
    """z2: the weights go first, as classes are fewer than hidden units; sums and products commute."""
    small = g.config.classes <= g.config.hidden
    return g.forward(linalg.node_transform(h1, w2), g.config.classes) if small else linalg.node_transform(g.forward(h1, g.config.hidden), w2)


def outputs(g: Graph, z2: DataFrame) -> DataFrame:
    return neural.log_softmax(z2) if g.config.activations else z2


def forward(g: Graph, w1, w2) -> DataFrame:
    return outputs(g, layer2(g, layer1(g, w1)[1], w2))


def start(config: TrainConfig):
    return graphs.weights(config.features, config.hidden, 1), graphs.weights(config.hidden, config.classes, 2)


def output_grad(g: Graph, out: DataFrame) -> DataFrame:
    """(node_id, x): gradient of the mean loss (or sum of block means) at z2; nodes that don't train have none and don't come."""
    block = partition.ceil_block(F.col("node_id"), g.n, g.config.loss_blocks)[0] if g.config.loss_blocks else F.lit(0)
    train = g.nodes.where("split = 'train'").select("node_id", "y", block.alias("block"))
    count = train.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    rows = out.join(train, "node_id").join(F.broadcast(count), "block")  # a row for each block of the setting
    hot = neural.one_hot(F.col("y"), g.config.classes)
    grad = F.zip_with("x", hot, lambda p, h: F.exp(p) - h) if g.config.activations else F.transform(hot, lambda h: -h)
    return rows.withColumn("x", grad).withColumn("x", F.transform("x", lambda v: v / F.col("n"))).select("node_id", "x")


def gradients(g: Graph, w1, w2) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(dw1, dw2, outputs, back), gradients as (i, j, v). The outputs and the gradient behind the product are written, as both layers read them."""
    z1, h1 = layer1(g, w1)
    out = g.tables.put(outputs(g, layer2(g, h1, w2)), "out")
    back = g.tables.put(g.backward(output_grad(g, out), g.config.classes), "back")
    dw2 = linalg.gram(h1, back)
    dh1 = linalg.node_transform(back, [list(c) for c in zip(*w2, strict=True)])
    g1 = dh1
    if g.config.activations:
        g1 = dh1.join(z1.select("node_id", F.col("x").alias("z")), "node_id").select("node_id", neural.relu_grad("z", "x").alias("x"))
    return linalg.gram(g.mx, g1), dw2, out, back


def losses(g: Graph, out: DataFrame) -> DataFrame:
    """node_id, split, loss, hit of every node."""
    rows = out.join(g.nodes.select("node_id", "y", "split"), "node_id")
    return rows.select("node_id", "split", (-F.element_at("x", F.col("y") + 1)).alias("loss"), (neural.argmax(F.col("x")) == F.col("y")).alias("hit"))


class Adam:
    """Adam on weights held by the driver; they are a few thousand numbers."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, layers: dict[int, list[list[float]]], grads: dict[tuple[int, int, int], float]) -> dict[int, list[list[float]]]:
        self.t += 1
        out = {}
        for layer, w in layers.items():
            rows = []
            for i, row in enumerate(w):
                new = []
                for j, x in enumerate(row):
                    k = (layer, i, j)
                    gr = grads.get(k, 0.0)
                    self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * gr
                    self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * gr * gr
                    new.append(x - self.rate * (self.m[k] / (1 - 0.9**self.t)) / ((self.v[k] / (1 - 0.999**self.t)) ** 0.5 + 1e-8))
                rows.append(new)
            out[layer] = rows
        return out


def collect_gradients(g: Graph, w1, w2) -> tuple[dict[tuple[int, int, int], float], DataFrame]:
    """Both layers' gradients, in one job, and the outputs; what comes to the driver has the size of the weights."""
    before = set(g.tables.manifest)
    dw1, dw2, out, back = gradients(g, w1, w2)
    rows = dw1.withColumn("layer", F.lit(1)).unionByName(dw2.withColumn("layer", F.lit(2))).collect()
    g.tables.drop(back)
    g.tables.drop_named("product", set(g.tables.manifest) - before)
    return {(r.layer, r.i, r.j): r.v for r in rows}, out


STATE = "layer int, i int, j int, w double, m double, v double, t int"


def state_rows(weights, adam: Adam) -> list[tuple]:
    """STATE rows: the weights and Adam's moments, 0 where there were no gradients."""
    return [(layer, i, j, float(x), adam.m.get((layer, i, j), 0.0), adam.v.get((layer, i, j), 0.0), adam.t) for layer, w in enumerate(weights, 1) for i, row in enumerate(w) for j, x in enumerate(row)]


def save_state(spark: SparkSession, path: str, config: TrainConfig, epoch: int, weights, adam: Adam, keep: int = 2) -> None:
    """Writes the state after an epoch as a version of its own, ``path/epoch=N``, and deletes versions before the last ``keep``.

    A version counts when Spark has written its success mark, so a run that is killed while it writes goes on from the one before.
    The settings are written once, beside the versions.
    """
    settings_path = f"{path}/settings"
    if not exists(spark, f"{settings_path}/_SUCCESS"):
        spark.createDataFrame([(json.dumps(asdict(config)),)], "config string").coalesce(1).write.mode("overwrite").parquet(settings_path)
    spark.createDataFrame(state_rows(weights, adam), STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch:06d}")
    for old in saved_epochs(spark, path)[:-keep]:
        remove(spark, f"{path}/epoch={old:06d}")


def saved_epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs whose state was written to its end, rising."""
    found = [f for f in folders(spark, path) if f.startswith("epoch=")]
    return [int(f.removeprefix("epoch=")) for f in found if exists(spark, f"{path}/{f}/_SUCCESS")]


def read_state(spark: SparkSession, path: str, config: TrainConfig):
    """(epoch, weights, Adam) of the last version, None if there is none. Raises ValueError if it was written with other settings (``epochs`` and ``runs`` may differ)."""
    epochs = saved_epochs(spark, path)
    if not epochs:
        return None
    free = ("epochs", "runs")
    written = json.loads(spark.read.parquet(f"{path}/settings").first().config)
    if any(written[k] != v for k, v in asdict(config).items() if k not in free):
        raise ValueError(f"{path} was written with other settings: {written}")
    rows = spark.read.schema(STATE).parquet(f"{path}/epoch={epochs[-1]:06d}").collect()  # of the weights' size
    shapes = {1: (config.features, config.hidden), 2: (config.hidden, config.classes)}
    layers = {k: [[0.0] * c for _ in range(r)] for k, (r, c) in shapes.items()}
    adam = Adam(config.rate)
    for r in rows:
        key = (r.layer, r.i, r.j)
        layers[r.layer][r.i][r.j], adam.m[key], adam.v[key], adam.t = r.w, r.m, r.v, r.t
    return epochs[-1], (layers[1], layers[2]), adam


def steps(g: Graph, epochs: int | None = None, checkpoint: str | None = None, every: int = 1):
    """After each step: the new weights (w1, w2) and the outputs of its forward pass, from before the update.

    The outputs' table is deleted when the next step is asked for. With a folder ``checkpoint``, the state is written there
    after each ``every`` epochs and after the last, and a run whose state is there goes on behind its last epoch: only later steps are given.
    """
    spark = g.nodes.sparkSession
    total = g.config.epochs if epochs is None else epochs
    found = read_state(spark, checkpoint, g.config) if checkpoint else None
    done, (w1, w2), adam = found or (0, start(g.config), Adam(g.config.rate))
    for epoch in range(done + 1, total + 1):
        grads, out = collect_gradients(g, w1, w2)
        new = adam.step({1: w1, 2: w2}, grads)
        w1, w2 = new[1], new[2]
        if checkpoint and (epoch % every == 0 or epoch == total):
            save_state(spark, checkpoint, g.config, epoch, (w1, w2), adam)
        yield (w1, w2), out
        g.tables.drop(out)


def train(g: Graph, epochs: int | None = None, checkpoint: str | None = None, every: int = 1):
    """Weights after each step: a list of (w1, w2), those it begins with first."""
    found = read_state(g.nodes.sparkSession, checkpoint, g.config) if checkpoint else None
    return [found[1] if found else start(g.config), *(w for w, _ in steps(g, epochs, checkpoint, every))]


HISTORY = "run int, epoch int, split string, loss double, accuracy double"


def history(g: Graph, epochs: int) -> DataFrame:
    """run, epoch, split, loss, accuracy of the forward pass of each step, before its update. Each epoch's rows are added to one table; the plan stays a scan of it."""
    path = f"{g.tables.folder}/history"
    for run in range(1, g.config.runs + 1):
        for epoch, (_, out) in enumerate(steps(g, epochs), 1):
            part = losses(g, out).groupBy("split").agg(F.avg("loss").alias("loss"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
            part = part.select(F.lit(run).alias("run"), F.lit(epoch).alias("epoch"), "split", "loss", "accuracy")
            part.coalesce(1).write.mode("append").parquet(path)
    return g.nodes.sparkSession.read.schema(HISTORY).parquet(path)


# --- weights as tables ---------------------------------------------------------------


def start_table(g: Graph) -> DataFrame:
    """STATE rows of the starting weights, made by expressions over their indices: nothing of their size passes through the driver."""
    c, spark = g.config, g.nodes.sparkSession
    parts = []
    for layer, (rows, cols) in {1: (c.features, c.hidden), 2: (c.hidden, c.classes)}.items():
        cells = spark.range(rows * cols).select(F.lit(layer).alias("layer"), F.floor(F.col("id") / cols).cast("int").alias("i"), (F.col("id") % cols).cast("int").alias("j"))
        parts.append(cells.withColumn("w", graphs.uniform(F.col("i"), F.col("j"), layer)))
    zero = F.lit(0.0)
    return parts[0].unionByName(parts[1]).select("layer", "i", "j", "w", zero.alias("m"), zero.alias("v"), F.lit(0).alias("t"))


def adam_table(state: DataFrame, grads: DataFrame, rate: float) -> DataFrame:
    """STATE after an Adam step: ``state`` joined with ``grads`` (layer, i, j, g); a cell without gradient has 0."""
    rows = state.join(grads.select("layer", "i", "j", "g"), ["layer", "i", "j"], "left")
    g, t = F.coalesce("g", F.lit(0.0)), F.col("t") + 1
    m, v = 0.9 * F.col("m") + 0.1 * g, 0.999 * F.col("v") + 0.001 * g * g
    rows = rows.select("layer", "i", "j", "w", m.alias("m"), v.alias("v"), t.alias("t"))
    first, second = F.col("m") / (1 - F.pow(F.lit(0.9), F.col("t"))), F.col("v") / (1 - F.pow(F.lit(0.999), F.col("t")))
    return rows.withColumn("w", F.col("w") - rate * first / (F.sqrt(second) + 1e-8))


def weight_rows(state: DataFrame, layer: int, turned: bool = False) -> DataFrame:
    """(i, row) of a layer's weights, row an array in the order of j; of their transpose if ``turned``."""
    i, j = ("j", "i") if turned else ("i", "j")
    return state.where(F.col("layer") == layer).groupBy(F.col(i).alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(j).alias("j"), "w"))), lambda c: c["w"]).alias("row"))


def table_step(g: Graph, state: DataFrame) -> DataFrame:
    """STATE after one step of training whose weights and moments are tables all along, for layers that the driver can't hold.

    A product with the weights joins each node's features with the rows of the weights; a weight gradient stays a table (i, j, v).
    """
    c, put, before = g.config, g.tables.put, set(g.tables.manifest)
    z1 = put(linalg.transform_by_table(g.mx, weight_rows(state, 1), c.hidden), "z1")
    h1 = z1.withColumn("x", neural.relu("x")) if c.activations else z1
    out = put(outputs(g, g.forward(linalg.transform_by_table(h1, weight_rows(state, 2), c.classes), c.classes)), "out")
    back = put(g.backward(output_grad(g, out), c.classes), "back")
    g1 = linalg.transform_by_table(back, weight_rows(state, 2, True), c.hidden)
    if c.activations:
        g1 = g1.join(z1.select("node_id", F.col("x").alias("z")), "node_id").select("node_id", neural.relu_grad("z", "x").alias("x"))
    grads = linalg.gram(g.mx, g1).withColumn("layer", F.lit(1)).unionByName(linalg.gram(h1, back).withColumn("layer", F.lit(2)))
    new = put(adam_table(state, grads.withColumnRenamed("v", "g"), c.rate), "state")
    g.tables.drop(z1, out, back)
    g.tables.drop_named("product", set(g.tables.manifest) - before)
    return new


def table_steps(g: Graph, epochs: int) -> DataFrame:
    """STATE after ``epochs`` steps of ``table_step``; the states between are deleted."""
    state = g.tables.put(start_table(g), "state")
    for _ in range(epochs):
        before, state = state, table_step(g, state)
        g.tables.drop(before)
    return state


# --- outputs in blocks of classes ----------------------------------------------------


def class_blocks(w2, parts: int) -> list[tuple[int, int, list[list[float]]]]:
    """(block, first class, its columns of the weights) for blocks of ceil(classes / parts) classes; later blocks may be shorter or not there."""
    classes = len(w2[0])
    size = -(-classes // parts)
    return [(k, first, [row[first : first + size] for row in w2]) for k, first in enumerate(range(0, classes, size))]


def blocked_outputs(g: Graph, h1: DataFrame, w2, blocks: int) -> DataFrame:
    """(node_id, block, first, x): the outputs, a row for each node and block of classes; no row has all classes.

    log-softmax takes the largest score of a node over its blocks, then the sum of the exponentials over its blocks; what is put together of a node are numbers, not its scores.
    """
    parts = None
    for block, first, columns in class_blocks(w2, blocks):
        part = g.forward(linalg.node_transform(h1, columns), len(columns[0])).select("node_id", F.lit(block).alias("block"), F.lit(first).alias("first"), "x")
        parts = part if parts is None else parts.unionByName(part)
    if not g.config.activations:
        return parts
    z = g.tables.put(parts, "z2")
    norm = neural.log_norm(z)
    return z.join(norm, "node_id").select("node_id", "block", "first", F.transform("x", lambda v: v - F.col("norm")).alias("x"))


def blocked_grad(g: Graph, out: DataFrame) -> DataFrame:
    """(node_id, block, first, x): the gradient of the mean loss behind the outputs' blocks; a node's class is in one of its blocks."""
    train = g.nodes.where("split = 'train'").select("node_id", "y")
    n = train.count()
    rows = out.join(train, "node_id")
    hot = F.transform("x", lambda _, k: F.when(F.col("first") + k == F.col("y"), 1.0).otherwise(0.0))
    grad = F.zip_with("x", hot, lambda p, h: ((F.exp(p) if g.config.activations else F.lit(0.0)) - h) / n)
    return rows.select("node_id", "block", "first", grad.alias("x"))


def blocked_loss(g: Graph, out: DataFrame) -> DataFrame:
    """(split, loss): mean losses; only the block that has a node's class adds to them."""
    rows = out.join(g.nodes.select("node_id", "y", "split"), "node_id").where("y >= first AND y < first + size(x)")
    return rows.groupBy("split").agg(F.avg(-F.element_at("x", F.col("y") - F.col("first") + 1)).alias("loss"))


def blocked_gradients(g: Graph, w1, w2, blocks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dw1, dw2, outputs) as ``gradients`` gives them, with outputs, gradients and products of the second layer in blocks of classes all the way."""
    z1, h1 = layer1(g, w1)
    out = g.tables.put(blocked_outputs(g, h1, w2, blocks), "out")
    grad = blocked_grad(g, out)
    dw2 = dh1 = None
    for block, first, columns in class_blocks(w2, blocks):
        back = g.tables.put(g.backward(grad.where(F.col("block") == block).select("node_id", "x"), len(columns[0])), "back")
        own = linalg.gram(h1, back).withColumn("j", F.col("j") + first)
        dw2 = own if dw2 is None else dw2.unionByName(own)
        part = linalg.node_transform(back, [list(c) for c in zip(*columns, strict=True)])
        dh1 = part if dh1 is None else dh1.unionByName(part)
    g1 = linalg.summed(dh1.withColumn("w", F.lit(1.0)), ["node_id"], g.config.hidden)
    if g.config.activations:
        g1 = g1.join(z1.select("node_id", F.col("x").alias("z")), "node_id").select("node_id", neural.relu_grad("z", "x").alias("x"))
    return linalg.gram(g.mx, g1), dw2, out
