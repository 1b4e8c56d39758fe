"""Adjacencies that are stored in blocks: products with them move dense rows and partial sums, never edges.

A layout deals the edges into cells and says which cells need a node's row. A cell is one
bucket of a bucketed table, so a product joins the rows it is sent with the bucket where
it lies. The four layouts differ in how many cells a row is sent to and how many partial sums there are of a node:

====== ================================= ==================== ===================
layout cell                              row is sent to       sums of a node
====== ================================= ==================== ===================
1d     block of the source               1 cell               one for each block
15d    block of dst, replica of source   a cell a dst block   one for each replica
2d     block of dst, block of source     a cell a dst block   one a source block
3d     as 2d, source blocks in layers    a cell a dst block   one a block and layer
====== ================================= ==================== ===================
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import setting, shared_dir, store
from .linalg import summed
from .partition import ceil_block, floor_block, grid_side, stage_owner


@dataclass
class Layout:
    """``cells`` in all; ``row_of`` and ``column_of`` give the cell's row and column from dst and src; a cell is row * columns + column."""

    rows: int
    columns: int
    row_of: Callable[[Column], Column]
    column_of: Callable[[Column], Column]

    @property
    def cells(self) -> int:
        return self.rows * self.columns

    def cell(self, src: Column, dst: Column) -> Column:
        return (self.row_of(dst) * self.columns + self.column_of(src)).cast("int")

    def needed_by(self, src: Column) -> Column:
        """The cells that a source's row is sent to: its column's."""
        rows = F.sequence(F.lit(0), F.lit(self.rows - 1))
        return F.transform(rows, lambda i: (i * self.columns + self.column_of(src)).cast("int"))


def layout(kind: str, n: int, parts: int, replicas: int = 2) -> Layout:
    """The layout ``1d``, ``15d``, ``2d`` or ``3d`` of ``parts`` cells for n nodes."""
    first = lambda x: F.lit(0)
    if kind == "1d":
        return Layout(1, parts, first, lambda x: ceil_block(x, n, parts)[0])
    if kind == "15d":
        blocks = parts // replicas
        return Layout(blocks, replicas, lambda x: ceil_block(x, n, blocks)[0], lambda x: stage_owner(ceil_block(x, n, blocks)[0], parts, replicas))
    side = grid_side(parts, 2 if kind == "2d" else 3)
    if kind == "2d":
        return Layout(side, side, lambda x: floor_block(x, n, side)[0], lambda x: floor_block(x, n, side)[0])

    def layered(x: Column) -> Column:
        k, at = floor_block(x, n, side)
        size = F.when(k == side - 1, n - (side - 1) * (n // side)).otherwise(n // side)
        layer = F.least(F.floor(at / F.greatest(F.floor(size / side), F.lit(1))), F.lit(side - 1))
        return k * side + layer

    return Layout(side, side * side, lambda x: floor_block(x, n, side)[0], layered)


def bucket_names(spark: SparkSession, cells: int) -> list[int]:
    """For each cell a number whose bucket of ``cells`` buckets is the cell: Spark deals rows by a hash, so the numbers are found by hashing some."""
    found: dict[int, int] = {}
    tried = 0
    while len(found) < cells:
        step = 32 * cells
        numbers = spark.range(tried, tried + step).select(F.col("id").cast("int").alias("name"))
        rows = numbers.groupBy(F.pmod(F.hash("name"), F.lit(cells)).alias("bucket")).agg(F.min("name").alias("name")).collect()  # a row a cell
        found |= {r.bucket: r.name for r in rows if r.bucket not in found}
        tried += step
    return [found[k] for k in range(cells)]


@dataclass
class Blocks:
    """A stored adjacency: its table (src, dst, w, cell), layout, the names of its buckets and into how many by source and by destination a cell is split.

    A split cell's row goes to the buckets of its source's part, one for each part of the destinations.
    """

    table: DataFrame
    layout: Layout
    names: list[int]
    split: int = 1

    def bucket(self, cell: Column, src: Column, dst: Column) -> Column:
        return self._named(((cell * self.split + self._part(dst)) * self.split + self._part(src)).cast("int"))

    def _part(self, x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(self.split)).cast("int") if self.split > 1 else F.lit(0)

    def _lanes(self) -> Column:
        return F.sequence(F.lit(0), F.lit(self.split - 1))

    def for_source(self, src: Column) -> Column:
        """The buckets' numbers that a source's row is sent to."""
        part = self._part(src)
        return F.flatten(F.transform(self.layout.needed_by(src), lambda c: F.transform(self._lanes(), lambda k: ((c * self.split + k) * self.split + part).cast("int"))))

    def for_destination(self, dst: Column) -> Column:
        """The same for products with the transpose: the buckets in which a node may be a destination."""
        part, columns = self._part(dst), F.sequence(F.lit(0), F.lit(self.layout.columns - 1))
        cells = F.transform(columns, lambda j: self.layout.row_of(dst) * self.layout.columns + j)
        return F.flatten(F.transform(cells, lambda c: F.transform(self._lanes(), lambda k: ((c * self.split + part) * self.split + k).cast("int"))))

    def _named(self, cell: Column) -> Column:
        return F.element_at(F.array(*(F.lit(x) for x in self.names)), cell + 1)


#: While it is off, Spark may join by cell alone what is bucketed by cell.
BY_CELL = "spark.sql.requireAllClusterKeysForCoPartition"
#: Edges of a bucket, about; a cell that has more is split.
BUCKET_EDGES = 1_000_000


def store_blocks(adj: DataFrame, lay: Layout, edges: int = 0) -> Blocks:
    """Writes an adjacency as a table of one bucket a cell, sorted by source, in the shared folder. Cells are split where there are so many ``edges`` (about) that a task had more than BUCKET_EDGES."""
    spark = adj.sparkSession
    split = max(1, math.ceil(math.sqrt(edges / lay.cells / BUCKET_EDGES)))
    buckets = lay.cells * split * split
    blocks = Blocks(adj, lay, bucket_names(spark, buckets), split)
    name = f"weft_blocks_{uuid.uuid4().hex}"
    rows = adj.withColumn("cell", blocks.bucket(lay.cell(F.col("src"), F.col("dst")), F.col("src"), F.col("dst")))
    # dealt as the buckets are, so that a bucket is one file
    rows = rows.repartition(buckets, "cell")
    rows.write.bucketBy(buckets, "cell").sortBy("src").option("path", f"{shared_dir(spark)}/graph/{name}").saveAsTable(name)
    blocks.table = spark.table(name)
    return blocks


def partial_sums(blocks: Blocks, h: DataFrame, width: int, turned: bool = False) -> DataFrame:
    """(node_id, x) by dst, of the transpose if ``turned`` by src. Rows of h are sent to the cells that need them; edges are read where they lie; sums of a cell's edges go on to their node."""
    key, other = ("dst", "src") if turned else ("src", "dst")
    to = (blocks.for_destination if turned else blocks.for_source)(F.col("node_id"))
    rows = h.select(F.col("node_id").alias(key), "x", F.explode(to).alias("_cell"))
    rows = rows.select(key, "x", blocks._named(F.col("_cell")).alias("cell"))
    both = blocks.table.join(rows, ["cell", key]).select(F.col(other).alias("node_id"), "w", "x")
    return summed(both, ["node_id"], width)


def spmm(blocks: Blocks, h: DataFrame, width: int, turned: bool = False) -> DataFrame:
    """The product of a stored adjacency (its transpose if ``turned``) and h, stored. While it runs, Spark may join by cell alone what is bucketed by cell."""
    with setting(h.sparkSession, BY_CELL, "false"):
        return store(partial_sums(blocks, h, width, turned), "product")
