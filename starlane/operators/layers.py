"""Message passing for inference: layers of mean aggregation over bounded samples of neighbours, with weights of their own for each relation.

Vectors are array columns, weights plain lists of rows. Means are taken element by element in one aggregation, so vectors are never exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Matrix = list[list[float]]


@dataclass(frozen=True)
class Weights:
    """What a layer does with the neighbours' mean (matrix and bias) and with the node itself (matrix)."""

    neighbours: Matrix
    bias: list[float]
    own: Matrix


def sampled(edges: DataFrame, most: int, seed: str = "") -> DataFrame:
    """Each node's in-neighbours, `most` of them at most: those with the smallest hashes, so that reruns agree.

    A rank with a small bound is also taken before the shuffle, by each task of the rows that it has read: of a hub's edges no more than that from each of them move.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed), "src", "dst"))
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("__h", "src"))
    return edges.select("src", "dst").distinct().withColumn("__h", order).withColumn("__i", rank).where(F.col("__i") <= most).select("src", "dst")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times(matrix: Matrix, vector: Column) -> Column:
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in matrix))
    return F.transform(rows, lambda row: dot(row, vector))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def neighbour_means(features: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """node, mean: of the vectors x of those that point at it; nodes at which none points are not there."""
    rows = edges.join(features.select(F.col("node").alias("src"), "x"), "src")
    return rows.groupBy(F.col("dst").alias("node")).agg(F.array(*(F.avg(F.get("x", i)) for i in range(width))).alias("mean"))


def layer(features: DataFrame, relations: list[tuple[DataFrame, Weights]], across: str = "sum") -> DataFrame:
    """node, x: for each relation, W mean(neighbours) + b + V x; over relations their sum, mean or max by element; then no element below 0.

    A node without neighbours in a relation has a mean of zeros there.
    """
    out = features.select("node", "x")
    parts = []
    for i, (edges, w) in enumerate(relations):
        width = len(w.neighbours[0])
        means = neighbour_means(features, edges, width).withColumnRenamed("mean", f"__m{i}")
        out = out.join(means, "node", "left")
        mean = F.coalesce(f"__m{i}", F.array(*(F.lit(0.0),) * width))
        parts.append(plus(plus(times(w.neighbours, mean), F.array(*(F.lit(float(b)) for b in w.bias))), times(w.own, F.col("x"))))
    z = parts[0]
    for p in parts[1:]:
        z = F.zip_with(z, p, lambda a, b: F.greatest(a, b)) if across == "max" else plus(z, p)
    if across == "mean":
        z = F.transform(z, lambda x: x / float(len(parts)))
    return out.select("node", relu(z).alias("x"))


def two_layers(features: DataFrame, relations: list[tuple[DataFrame, Weights, Weights]], most: tuple[int, int] = (15, 10), across: str = "sum") -> DataFrame:
    """node, x after two layers; relations: (edges, weights of the first layer, of the second). most: neighbours that a node is given in the last layer, and in the one before it."""
    last, before = most
    first = layer(features, [(sampled(e, before, "1"), w) for e, w, _ in relations], across)
    return layer(first, [(sampled(e, last, "2"), w) for e, _, w in relations], across)


def head(embedded: DataFrame, weights: list[float], bias: float) -> DataFrame:
    """node, x, score: a linear score of the vectors through the logistic function."""
    z = dot(F.array(*(F.lit(float(w)) for w in weights)), F.col("x")) + F.lit(float(bias))
    return embedded.withColumn("score", 1.0 / (1.0 + F.exp(-z)))
