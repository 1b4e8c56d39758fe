"""Row functions on arrays of scores."""

from __future__ import annotations

from pyspark.sql import functions as F


def total(x):
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def relu(x):
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def relu_grad(z, g):
    return F.zip_with(z, g, lambda a, b: F.when(a > 0, b).otherwise(0.0))


def bound(value, use):
    """``use`` of a value that is computed once a row. A column that a lambda reads is inlined into it by the optimiser, and then computed for each element."""
    return F.transform(F.array(value), use)[0]


def log_softmax(df, column: str = "x"):
    """The frame with log-softmax of its array column, shifted by the row's largest score."""

    def shifted(x):
        norm = lambda top: F.log(total(F.transform(x, lambda v: F.exp(v - top))))
        return bound(F.array_max(x), lambda top: bound(norm(top), lambda n: F.transform(x, lambda v: v - top - n)))

    return df.withColumn(column, bound(F.col(column), shifted))


def log_norm(z):
    """(node_id, norm) of scores in several rows a node: the logarithm of the sum of all exponentials, shifted by each row's largest score, then by the node's."""
    row = z.select("node_id", F.array_max("x").alias("top"), "x").withColumn("s", total(F.transform("x", lambda v: F.exp(v - F.col("top")))))
    tops = row.groupBy("node_id").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "s")).alias("parts"))  # two numbers a block
    return tops.select("node_id", (F.col("top") + F.log(F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["s"] * F.exp(p["top"] - F.col("top"))))).alias("norm"))


def log_softmax_grad(p, g, summed):
    """Gradient at the scores, given log-probabilities p, the gradient g at them, and ``summed``, a column with g's sum."""
    return bound(summed, lambda s: F.zip_with(p, g, lambda a, b: b - F.exp(a) * s))


def argmax(x):
    """The first place of the largest score, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def one_hot(y, classes: int):
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == y, 1.0).otherwise(0.0))
