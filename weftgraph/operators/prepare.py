"""Graph preparation: duplicates, self loops, degrees, normalisation, diffusion."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import neural
from ..sources.store import Tables, store
from . import grid, hubs


#: Rows of one task where edges or entries are put together by key.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``n`` rows dealt by ``keys`` into tasks of about TASK_ROWS each, so that a task's table of keys stays as large however many rows there are; few rows as they are."""
    tasks = math.ceil(n / TASK_ROWS)
    return rows.repartition(tasks, *keys) if tasks > 8 else rows


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def summed_edges(edges: DataFrame) -> DataFrame:
    """Repeated cells become one whose weight is the sum."""
    weight = F.col("w") if "w" in edges.columns else F.lit(1)
    return edges.groupBy("src", "dst").agg(F.sum(weight).alias("w"))


def sorted_pairs(batches, rows: int = 2_000_000):
    """The pairs (a, b) of Arrow batches without nulls, about ``rows`` at a time: sorted and each once."""

    def made() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        if min(a.min(), b.min()) >= 0 and max(a.max(), b.max()) < 1 << 31:
            pair = np.sort((a << 32) | b)
            pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])]
            a, b = pair >> 32, pair & ((1 << 32) - 1)
        else:
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            a, b = a[new], b[new]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
        if n >= rows:
            yield made()
            held, n = [], 0
    if held:
        yield made()


def symmetric(edges: DataFrame) -> DataFrame:
    """Distinct edges in both directions, without self pairs."""
    n = edges.count()  # of a table in Parquet from its metadata
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    if n > 8 * TASK_ROWS:  # those of a task are put together and sorted before they are sent: fewer, and packed better
        pairs = pairs.mapInArrow(sorted_pairs, "a long, b long")
    pairs = dealt(pairs, ["a", "b"], n).distinct()
    ways = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.select(F.inline(ways))


def with_self_loops(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Exactly one self loop at each node."""
    return edges.where("src <> dst").select("src", "dst").unionByName(ids.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst")))


def transpose(adj: DataFrame) -> DataFrame:
    return adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in adj.columns if c not in ("src", "dst")))


def degrees(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """node_id, d: edges that leave a node, loops and repeats included; 0 for a node without."""
    d = edges.groupBy(F.col("src").alias("node_id")).agg(F.sum(F.col("w")).alias("d") if "w" in edges.columns else F.count(F.lit(1)).alias("d"))
    return ids.select("node_id").join(d, "node_id", "left").select("node_id", F.coalesce("d", F.lit(0)).alias("d"))


def inverse_root(d):
    """1 / sqrt(d), 0 where d is 0."""
    return F.when(d > 0, 1 / F.sqrt(d)).otherwise(0.0)


def normalised(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """src, dst, w: the symmetric normalisation D^-1/2 A D^-1/2 with degrees of the sources."""
    # written, so that Spark knows its size: where it is small, no edge is moved for it
    d = store(degrees(edges, ids).select("node_id", inverse_root(F.col("d")).alias("r")), "roots")
    a, b = (d.select(F.col("node_id").alias(c), F.col("r").alias(f"r_{c}")) for c in ("src", "dst"))
    own = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (own * F.col("r_src") * F.col("r_dst")).alias("w"))


def normalised_plus_identity(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """As ``normalised`` for A + I: loops that are there already count twice."""
    loops = ids.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    edges = store(edges.select("src", "dst"), "edges")
    all_ = dealt(edges.unionByName(loops), ["src", "dst"], edges.count())
    return normalised(store(summed_edges(all_), "edges"), ids)


def row_normalised(nodes: DataFrame) -> DataFrame:
    """Features divided by their sum, or by 1 where that is less."""
    total = F.greatest(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), F.lit(1.0))
    return nodes.withColumn("x", neural.bound(total, lambda s: F.transform("x", lambda v: v / s)))


def pagerank_step(adj: DataFrame, state: DataFrame | None, ids: DataFrame, alpha: float) -> DataFrame:
    """alpha I + (1 - alpha) T S as (src, dst, w); ``state`` None is the identity."""
    step = store(adj.select("src", "dst", "w") if state is None else multiply(adj, state), "step")
    moved = step.select("src", "dst", ((1 - alpha) * F.col("w")).alias("w"))
    stay = ids.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(alpha).alias("w"))
    return dealt(moved.unionByName(stay), ["src", "dst"], step.count()).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def push_step(adj: DataFrame, state: DataFrame, roots: DataFrame, alpha: float, eps: float, bound: int = 10_000_000) -> tuple[DataFrame, DataFrame]:
    """(front, next state) of one round of ``push_pagerank``. ``roots`` is (node_id, g), the root of each degree; a state is (src, dst, p, r)."""
    a, b = (roots.select(F.col("node_id").alias(c), F.col("g").alias(f"g_{c}")) for c in ("src", "dst"))
    marked = state.join(a, "src").join(b, "dst").withColumn("push", F.col("r") > eps * F.col("g_src") * F.col("g_dst"))
    front = marked.where("push").select("src", "dst", F.col("r").alias("w"))
    stay = marked.select("src", "dst", F.when(F.col("push"), F.col("p") + alpha * F.col("r")).otherwise(F.col("p")).alias("p"), F.when(F.col("push"), 0.0).otherwise(F.col("r")).alias("r"))
    front = store(front, "front")
    moved = store(hubs.multiply(adj, front, bound), "moved")
    n = moved.count() + state.count()
    moved = moved.select("src", "dst", F.lit(0.0).alias("p"), ((1 - alpha) * F.col("w")).alias("r"))
    return front, dealt(stay.unionByName(moved), ["src", "dst"], n).groupBy("src", "dst").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))


def push_pagerank(adj: DataFrame, ids: DataFrame, degree: DataFrame, alpha: float, eps: float, steps: int | None = None) -> DataFrame:
    """Personalised PageRank alpha (I - (1 - alpha) T)^-1 by pushing residuals, as (src, dst, p, r): estimate p and what is left to push, r.

    T is the symmetric normalisation of a graph with the degrees ``degree`` (node_id, d). An entry whose residual exceeds ``eps`` times the root of the degrees of its
    row and column is pushed: alpha of it is kept as estimate, the rest goes to the neighbours; what is below waits for
    more. It ends when nothing is above (or after ``steps`` rounds). Then each estimate is at most eps sqrt(d_src d_dst) too low, and the state never has
    more than 1 / (alpha eps) rows a column, whatever the number of nodes: a push of a node of degree d takes alpha eps d of a column's mass, of which there is 1, and makes d rows.

    Each round is written and the one before it deleted. Nodes of degree 0 keep alpha of their own.
    """
    tables = Tables(adj.sparkSession, "push")
    roots = tables.put(degree.select("node_id", F.sqrt(F.greatest("d", F.lit(1))).alias("g")), "roots")
    adj = tables.put(adj.select("src", "dst", "w"), "adj")
    state = tables.put(ids.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(0.0).alias("p"), F.lit(1.0).alias("r")), "state")
    done = 0
    while steps is None or done < steps:
        front, following = push_step(adj, state, roots, alpha, eps)
        if front.isEmpty():
            break
        before, state = state, tables.put(following, "state")
        tables.drop(before)
        done += 1
    return state


def column_top(state: DataFrame, k: int, by: str = "w") -> DataFrame:
    """The k largest entries of each column (by ``by``), ties by row, divided by their sum."""
    largest = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc(by), "src"))
    kept = state.withColumn("_k", largest).where(F.col("_k") <= k)
    return kept.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("dst"))).alias("w"))


def multiply(left: DataFrame, right: DataFrame, bound: int = 10_000_000) -> DataFrame:
    """Sparse times sparse, both (src, dst, w). Both are written once. Small dense ones are multiplied in a grid that shuffles copies, others in blocks that are stored and read by the tasks; hubs.multiply has what is left, see grid.plan."""
    tables = Tables(left.sparkSession, "factors")
    a = tables.put(left.select("src", "dst", "w"), "left")
    b = a if right is left else tables.put(right.select("src", "dst", "w"), "right")
    g, stored = grid.plan(a, b)
    if g:
        return grid.multiply(a, b, g)
    if not stored:
        return hubs.multiply(a, b, bound)
    slices = grid.blocks_of(b.count())
    blocks = grid.blocks_of(n := a.count(), min(math.ceil(n / TASK_ROWS), math.ceil(16 / slices)))
    return multiply_dealt(grid.by_block(a, "src", blocks), grid.by_block(b, "dst", slices), blocks, slices, bound)


def multiply_dealt(left: DataFrame, right: DataFrame, blocks: int, slices: int, bound: int) -> DataFrame:
    """Sparse times sparse of factors (src, dst, w, block) that grid.by_block has dealt, by rows and by columns; by hubs.multiply if there are nulls or a row or column makes a block far too large."""
    tables = Tables(left.sparkSession, "blocks")
    paths = [grid.store_blocks(x.withColumn("w", F.col("w").cast("double")), k, tables, name) for x, k, name in ((left, "dst", "rows"), (right, "src", "columns"))]
    a, b = (left.sparkSession.read.schema("src long, dst long, w double, block int").parquet(p) for p in paths)
    most = max(x.groupBy("block").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] for x in (a, b))
    if most > 3 * grid.BLOCK or not all(x.where("src IS NULL OR dst IS NULL OR w IS NULL").isEmpty() for x in (a, b)):
        return hubs.multiply(a.drop("block"), b.drop("block"), bound)
    return grid.multiply_stored(tables, paths[0], blocks, paths[1], slices)
