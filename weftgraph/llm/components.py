"""Connected components of an edge table, by repeated minima and pointer jumps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: As many edges of a task are taken together at a time.
TOGETHER = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) do: from each id to the smallest one it can reach, at most one an id."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while len(i):
        i, j = label[i], label[j]
        differ = i != j
        i, j = i[differ], j[differ]
        np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
        while (label != label[label]).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: a task's edges become stars, so their number is that of the ids."""

    def run(batches):
        rows, held = [], 0

        def made() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate([r.column(k).to_numpy() for r in rows]) for k in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows.append(batch)
            held += batch.num_rows
            if held >= TOGETHER:
                yield made()
                rows, held = [], 0
        if held:
            yield made()

    return edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component) of every end of the edges (a, b): component is the smallest id that can be reached.

    With ``known``, the components (id, component) of other edges, both are taken together: only
    edges between different components of those are followed.

    Edges are contracted in their tasks first, so pairs of a large group cost its size. Each round takes the least label among the neighbours and then the label of that
    label; it ends when no label changes. Every round is written to the shared folder, so
    neither the lineage nor the driver grows. No edges: an empty table.
    """
    if known is not None:
        for x in "ab":
            of = known.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
            edges = edges.join(of, F.col(x) == F.col("_id"), "left").select(F.coalesce("_component", x).alias(x), "b" if x == "a" else "a")
        joined = components(edges)
        of = joined.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
        moved = known.join(of, F.col("component") == F.col("_id"), "left").select("id", F.coalesce("_component", "component").alias("component"))
        return materialise(moved.unionByName(joined.join(known, "id", "left_anti")), "labels")
    edges = contracted(edges.where("a <> b").select("a", "b"))
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("_near"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        jump = labels.select(F.col("id").alias("_at"), F.col("label").alias("_to"))
        step = step.join(jump, F.col("_new") == F.col("_at"), "left").select("id", "_old", F.least("_new", "_to").alias("label"))
        step = materialise(step, "labels")
        labels = step.select("id", "label")
        if step.where("label <> _old").isEmpty():
            return labels.withColumnRenamed("label", "component")
