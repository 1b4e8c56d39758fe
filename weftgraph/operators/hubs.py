"""Joins on keys of which some have very many rows: heavy keys are split into parts, and the other side comes once for each part."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import store
from .linalg import summed

#: Heavy keys there can be at most: the bound on a key's rows rises with the table so that no more fit above it.
MOST_HEAVY = 100_000


def heavy_keys(rows: DataFrame, key: str, bound: int, weight: str | None = None) -> DataFrame:
    """(key, parts): keys of more than ``bound`` rows (or more ``weight`` in all) and how many parts of ``bound`` they make.

    As every heavy key takes more than ``bound`` of the total, there are fewer of them than total / ``bound``; the bound is raised to
    total / MOST_HEAVY where it is less, so the result has at most MOST_HEAVY rows of two numbers and may be broadcast.
    """
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = rows.groupBy(key).agg(size.alias("_n"))
    total = rows.agg(F.coalesce(size, F.lit(0))).first()[0]
    bound = max(bound, math.ceil(total / MOST_HEAVY), 1)
    return counts.where(F.col("_n") > bound).select(key, F.ceil(F.col("_n") / bound).cast("int").alias("parts"))


def with_part(rows: DataFrame, key: str, heavy: DataFrame, spread: list[str]) -> DataFrame:
    """``rows`` with ``part``: 0, or for a heavy key one of its parts, by a hash of the columns ``spread``."""
    out = rows.join(F.broadcast(heavy), key, "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.col("parts")).cast("int"))
    return out.withColumn("part", part).drop("parts")


def for_each_part(rows: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """``rows`` with ``part``: one row, or for a heavy key one for each of its parts."""
    out = rows.join(F.broadcast(heavy), key, "left")
    return out.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def joined(adj: DataFrame, h: DataFrame, heavy: DataFrame) -> DataFrame:
    """(dst, w, x) of each edge, with its source's row; ``adj`` has parts of its heavy sources."""
    sources = for_each_part(h.select(F.col("node_id").alias("src"), "x"), "src", heavy)
    return adj.join(sources, ["src", "part"]).select("dst", "w", "x")


def spmm(adj: DataFrame, h: DataFrame, width: int, heavy: DataFrame) -> DataFrame:
    """As linalg.spmm for an adjacency with parts. The edges of a hub lie in tasks of ``bound`` edges each, its row is sent to each of them, and their sums are added by dst."""
    return summed(joined(adj, h, heavy).withColumnRenamed("dst", "node_id"), ["node_id"], width)


#: Products that a task of a sparse product adds up, and entries of a packed row at most.
TASK_PRODUCTS, PACKED = 2_000_000, 100_000


def multiply(left: DataFrame, right: DataFrame, bound: int) -> DataFrame:
    """Sparse times sparse, both (src, dst, w), in two phases: the products of each inner index are counted, then made.

    An inner index k that a rows of left and b of right share makes a times b products. Where that is more than ``bound``, the longer side's
    rows are dealt into parts and the other side's are sent to each, so that no task makes much more than ``bound`` products of one index. An entry of the left is
    sent on with its row of the right, packed, and meets the others of its row where products are made and added: what is shuffled are packed rows, in tasks
    of TASK_PRODUCTS products each. Packed rows are cut into slices by column where a row is long or has many products. Both sides are read several times, so they are better stored.
    """
    a = left.groupBy(F.col("dst").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(F.col("src").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    work = a.join(b, "k").withColumn("n", F.col("a") * F.col("b"))
    heavy = heavy_keys(work, "k", bound, "n")
    # a part has one row of the longer side at least
    heavy = store(heavy.join(work, "k").select("k", F.least("parts", F.greatest("a", "b")).alias("parts"), (F.col("a") >= F.col("b")).alias("split_left")), "heavy")
    rows = left.select("src", F.col("dst").alias("k")).join(b, "k").groupBy("src").agg(F.sum("b").alias("n"), F.max("b").alias("b"))
    total, most, longest = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()
    slices = max(1, math.ceil(most / (2 * TASK_PRODUCTS)), math.ceil(longest / PACKED))
    l = left.select("src", F.col("dst").alias("k"), "w").join(F.broadcast(heavy), "k", "left")
    r = right.select(F.col("src").alias("k"), F.col("dst").alias("c"), F.col("w").alias("v")).join(F.broadcast(heavy), "k", "left")
    parts = F.coalesce("parts", F.lit(1))

    def dealt(rows: DataFrame, by: str, split) -> DataFrame:
        one = F.array(F.pmod(F.xxhash64(by), parts).cast("int"))
        return rows.withColumn("part", F.explode(F.when(split, one).otherwise(F.sequence(F.lit(0), parts - 1)))).drop("parts", "split_left")

    l, r = dealt(l, "src", F.coalesce("split_left", F.lit(True))), dealt(r, "c", ~F.coalesce("split_left", F.lit(False)))
    r = r.withColumn("slice", F.pmod(F.xxhash64("c"), F.lit(slices)).cast("int")).groupBy("k", "part", "slice").agg(F.collect_list(F.struct("c", "v")).alias("_r"))
    r = r.select("k", "part", "slice", F.col("_r.c").alias("c"), F.col("_r.v").alias("v"))
    both = l.join(r, ["k", "part"]).select("src", "slice", "w", "c", "v")
    tasks = math.ceil(total / TASK_PRODUCTS)
    both = both.repartition(tasks, "src", "slice") if tasks > 8 else both.repartition("src", "slice")
    made = both.select("src", "slice", "w", F.inline(F.arrays_zip("c", "v")))
    return made.groupBy("src", "slice", F.col("c").alias("dst")).agg(F.sum(F.col("w") * F.col("v")).alias("w")).drop("slice")
