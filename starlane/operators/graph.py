"""Graph operators on edge DataFrames. Loops write each round into the shared scratch folder, so that lineage stays short and executors may be lost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.sources.scratch import saved


def ranked(df: DataFrame, order: list[Column], rank: str, sums: dict[str, str] | None = None) -> DataFrame:
    """df with its row number from 1 in a total order, and running sums (name: column), without one task for all.

    Rows are numbered and summed in range partitions, and what the partitions before hold is added.
    """
    sums = sums or {}
    parts = saved(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    held = parts.groupBy("__part").agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{name}") for name, c in sums.items()))
    # One row for each partition.
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("__part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__n", *(f"__{name}" for name in sums))))
    inside = Window.partitionBy("__part").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = parts.withColumns({"__i": F.row_number().over(inside), **{f"__{name}": F.sum(c).over(upto) for name, c in sums.items()}}).join(before, "__part")
    return rows.select(*df.columns, (F.col("__n_before") + F.col("__i")).cast("long").alias(rank), *((F.col(f"__{name}_before") + F.col(f"__{name}")).alias(name) for name in sums))


def percentiles(df: DataFrame, group: str, value: str, qs: tuple[float, ...]) -> DataFrame:
    """group, n, and q<percent> for each of qs: exact, between two values in proportion to their distance. Nulls do not count.

    Equal values are counted first, and counts are summed in range partitions, so that no task holds a group's values. Of each group only the rows at the ranks asked for are left.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    rows = saved(ranked(counts, [F.col(group), F.col("__v")], "__rank", {"__upto": "__c"}))
    all_ = rows.groupBy(group).agg(F.sum("__c").alias("n"), F.min(F.col("__upto") - F.col("__c")).alias("__before"))
    # One row for each group: the join adds no more than a group's own numbers to it.
    at = rows.join(all_, group).withColumns({"__hi": F.col("__upto") - F.col("__before"), "__lo": F.col("__upto") - F.col("__before") - F.col("__c")})
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    holds = lambda k: (F.col("__lo") <= k) & (k < F.col("__hi"))
    needed = [holds(f(place(q))) for q in qs for f in (F.floor, F.ceil)]
    found = at.where(reduce(lambda a, b: a | b, needed)).groupBy(group, "n").agg(*(F.max(F.when(holds(f(place(q))), F.col("__v"))).alias(f"__{name}{i}") for i, q in enumerate(qs) for name, f in (("a", F.floor), ("b", F.ceil))))
    between = lambda i, q: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * (place(q) - F.floor(place(q)))
    return found.select(group, "n", *(between(i, q).alias(f"q{round(q * 100)}") for i, q in enumerate(qs)))


def node_ids(nodes: DataFrame, key: str) -> DataFrame:
    """key, idx: contiguous from 0 in the order of the key."""
    return ranked(nodes.select(key).distinct(), [F.col(key)], "idx").withColumn("idx", F.col("idx") - 1)


def remap(edges: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Both ends by their ids; parallel edges stay."""
    a, b = ids.select(F.col(key).alias("src"), F.col("idx").alias("s")), ids.select(F.col(key).alias("dst"), F.col("idx").alias("d"))
    return edges.select("src", "dst").join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without loops."""
    e = edges.select("src", "dst").where("src <> dst")
    return e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """In and out together, with multiplicity."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Edges among nodes that keep k ends or more once all others are peeled off."""
    alive = saved(edges.select("src", "dst"))
    while True:
        low = saved(degrees(alive).where(F.col("degree") < k).select("node"))
        if low.isEmpty():
            return alive
        alive = saved(alive.join(low.withColumnRenamed("node", "src"), "src", "left_anti").join(low.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def core_graph(edges: DataFrame, k: int, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The k-core under ids of its own: (node, idx in the whole graph, local in the core), and its edges by local ids with parallel ones kept.

    ids: node and idx of the whole graph, where they are known already. Both ids are contiguous from 0 in the order of the nodes.
    """
    ids = node_ids(edges.select(F.explode(F.array("src", "dst")).alias("node")), "node") if ids is None else ids
    core = k_core(edges, k)
    local = saved(node_ids(core.select(F.explode(F.array("src", "dst")).alias("node")), "node"))
    return ids.join(local.withColumnRenamed("idx", "local"), "node"), remap(core, local, "node")


def reachable(edges: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """node, distance: all within so many steps of the seeds (along edges)."""
    seen = saved(seeds.select("node").distinct().withColumn("distance", F.lit(0)))
    front = seen
    for step in range(1, steps + 1):
        found = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct()
        front = saved(found.join(seen, "node", "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            break
        seen = saved(seen.unionByName(front))
    return seen


def mean_neighbours(edges: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """node, and for each column its mean over the node's in-neighbours: one layer of mean aggregation."""
    rows = edges.join(features.withColumnRenamed("node", "src"), "src")
    return rows.groupBy(F.col("dst").alias("node")).agg(*(F.avg(c).alias(c) for c in columns))
