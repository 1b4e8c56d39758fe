"""Graphs and node tables from Parquet tables, generated features and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import store

PRIME = 2147483647
NODES = "node_id long, x array<double>, y int, split string"
EDGES = "src long, dst long"


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str, edges_format: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """A user's graph: a Parquet table of nodes (NODES) and one of edges (EDGES), or CSV edges without a header; see checked_graph."""
    nodes = spark.read.schema(NODES).parquet(nodes_path)
    return checked_graph(nodes, spark.read.schema(EDGES).format(edges_format).load(edges_path))


def checked_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (src, dst) whose ids run from 0 to n - 1: as they come, or numbered by rising id where they have gaps.

    Raises ValueError if an id or a feature is null, an id is repeated, or an edge has an
    end that is no node.
    """
    empty = [F.col(c).isNull() for c in nodes.columns if c in ("node_id", "x")]
    if "x" in nodes.columns:
        empty.append(F.exists("x", lambda v: v.isNull()))
    missing = F.count(F.when(F.array_max(F.array(*[F.coalesce(e, F.lit(False)) for e in empty])), 1))
    low, high, n, distinct, bad = nodes.agg(F.min("node_id"), F.max("node_id"), F.count(F.lit(1)), F.count_distinct("node_id"), missing).first()
    if bad or edges.where("src IS NULL OR dst IS NULL").take(1):
        raise ValueError("null ids or features")
    if distinct < n:
        raise ValueError("repeated node ids")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    if ends.join(nodes.select("node_id"), "node_id", "left_anti").take(1):
        raise ValueError("edges to nodes that aren't there")
    if not n or (low == 0 and high == n - 1):
        return nodes, edges.select("src", "dst")
    number = dense_ids(nodes)
    a, b = (number.select(F.col("node_id").alias(c), F.col("number").alias(f"_{c}")) for c in ("src", "dst"))
    edges = edges.select("src", "dst").join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    return nodes.join(number, "node_id").drop("node_id").withColumnRenamed("number", "node_id").select(*nodes.columns), edges


def dense_ids(ids: DataFrame) -> DataFrame:
    """(node_id, number): distinct ids numbered from 0 in rising order, each range of ids in a task of its own."""
    ranges = store(ids.select("node_id").distinct().repartitionByRange("node_id").withColumn("_range", F.spark_partition_id()), "ids")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("node_id")) - 1
    return ranges.withColumn("_rank", rank).join(F.broadcast(starts), "_range").select("node_id", (F.col("_start") + F.col("_rank")).cast("long").alias("number"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_count(spark: SparkSession, sf_dir: str) -> int:
    """Nodes of the embeddings graph; from Parquet metadata."""
    return table(spark, sf_dir, "embeddings").count()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, x (array of doubles), y, split: 0-5 of vec_id's last digit train, 6-7 val, 8-9 test."""
    digit = F.col("vec_id") % 10
    split = F.when(digit < 6, "train").when(digit < 8, "val").otherwise("test")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"), split.alias("split"))


def coo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as they come, repeated ones and self pairs included: order number and part number, modulo the nodes."""
    n = node_count(spark, sf_dir)
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % n).alias("src"), (F.col("l_partkey") % n).alias("dst"))


def uniform(i, j, layer: int):
    """A number in [0, 1) for (i, j, layer), the same in every engine."""
    a = (i.cast("long") * 4099 + j.cast("long") * 131 + layer * 7919 + 1) * 48271 % PRIME
    b = (a * (a % 65536 + 1) + layer) % PRIME
    return (b * 16807 + j.cast("long")) % PRIME / F.lit(float(PRIME))


def uniform_number(i: int, j: int, layer: int) -> float:
    a = (i * 4099 + j * 131 + layer * 7919 + 1) * 48271 % PRIME
    b = (a * (a % 65536 + 1) + layer) % PRIME
    return (b * 16807 + j) % PRIME / PRIME


def weights(rows: int, cols: int, layer: int) -> list[list[float]]:
    """Starting weights, uniform in [0, 1)."""
    return [[uniform_number(i, j, layer) for j in range(cols)] for i in range(rows)]


def synthetic_features(ids: DataFrame, width: int) -> DataFrame:
    """node_id, f, v: uniform features for graphs that come without."""
    return ids.select("node_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("f")).withColumn("v", uniform(F.col("node_id"), F.col("f"), 11))


def synthetic_labels(ids: DataFrame, classes: int) -> DataFrame:
    """node_id, y: floor of a uniform number below classes - 1, so the last class never occurs."""
    return ids.select("node_id", F.floor(uniform(F.col("node_id"), F.lit(0), 12) * (classes - 1)).cast("int").alias("y"))
