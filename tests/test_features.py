"""The counts behind features and models: odd lines against plain distinct counts, and how often lines are gone through."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from starlane.plans import models
from starlane.sources.bindings import Tables


@pytest.fixture
def odd(spark, tmp_path):
    """Lines without a node, without any value to count, repeated, and many of one node."""
    day = lambda d: datetime(1996, 1, d, 13)
    rows = [(1, 7, 1, 1, 50.0, 0.09, "A", "O", day(1)), (1, 7, 1, 1, 50.0, 0.09, "A", "O", day(1)), (2, 7, None, 2, 1.0, 0.08, "N", "F", day(2)), (3, 7, 2, 1, 2.0, None, "R", None, None)]
    rows += [(4, None, 1, 1, 46.0, 0.1, "N", "O", day(3)), (None, None, None, None, None, None, None, None, None), (None, 8, None, None, None, None, None, None, None)]
    rows += [(i % 50, 9, i % 3, i % 7, float(i % 50), 0.01 * (i % 11), "ANR"[i % 3], "OF"[i % 2], day(1 + i % 28)) for i in range(2000)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp").repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    return Tables(spark, str(tmp_path))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_odd_lines_without_copies_of_them(spark, odd):
    got = models.known(odd)
    assert "Expand" not in _plan(got)
    got = {r.node: r.asDict() for r in got.collect()}
    want = {r.node: r for r in odd.lineitem.groupBy(F.col("l_partkey").alias("node")).agg(
        F.count("*").alias("posts"), F.count_distinct("l_suppkey").alias("follows"), F.count_distinct("l_orderkey").alias("followers"), F.count_distinct(F.to_date("l_shipdate")).alias("active_days"),
        *(F.count(F.when(c, 1)).alias(k) for k, c in (("likes_out", F.col("l_returnflag") == "A"), ("blocks_in", F.col("l_quantity") > 45), ("blocks_out", F.col("l_quantity") < 3), ("reposts_out", F.col("l_linestatus") == "O"), ("quotes_out", F.col("l_linenumber") == 1), ("post_deletes", F.col("l_discount") > 0.08))),
        F.datediff(F.max("l_shipdate"), F.lit("1995-01-01")).alias("last_day"), F.datediff(F.min("l_shipdate"), F.lit("1995-01-01")).alias("first_day")).collect()}
    assert got.keys() == want.keys() == {None, 7, 8, 9}
    for node, r in want.items():
        assert {k: got[node][k] for k in r.asDict()} == r.asDict()
    assert got[None]["posts"] == 2 and got[8]["followers"] == got[8]["active_days"] == got[8]["follows"] == 0 and got[8]["last_day"] is None


def test_scaling_goes_through_lines_once(spark, odd):
    rows = models.stable_features(odd)
    assert "l_partkey" not in _plan(rows)
    assert {r.node for r in rows.collect()} == {None, 7, 8, 9}


def test_trees_go_through_lines_once(spark, sf_dir, monkeypatch):
    seen = []
    known = models.known
    monkeypatch.setattr(models, "known", lambda *a, **b: seen.append("known") or known(*a, **b))
    monkeypatch.setattr(models.learn, "boosted_trees", lambda rows, rest, *a: seen.append("l_partkey" in _plan(rows)) or rest.withColumn("probability", F.lit(0.5)))
    rows = models.boosted_trees(Tables(spark, sf_dir))
    assert seen == ["known", False, False]
    assert {r.split for r in rows.select("split").distinct().collect()} == {"temporal", "random"}


def test_lines_of_other_nodes_are_dropped_before_they_move(spark, odd):
    of = spark.createDataFrame([(7, 1), (7, 2), (None, 3), (99, 4)], "node long, x int")
    got = models.known(odd, of)
    plan = _plan(got)
    assert 0 <= plan.index("RepartitionByExpression") < plan.index("LeftSemi")
    assert got.collect() == models.known(odd).where("node = 7").collect()


def test_models_are_saved_from_lines_of_labelled_nodes(spark, sf_dir, tmp_path, monkeypatch):
    """Nodes that are labelled twice count twice, as in SQL."""
    for name in ("lineitem", "embeddings"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels.union(labels.where("doc_id % 3 = 0")).write.parquet(f"{tmp_path}/labels.parquet")
    plans, saved = [], models.graph.saved
    monkeypatch.setattr(models.graph, "saved", lambda df: plans.append(_plan(df)) or saved(df))
    t = Tables(spark, str(tmp_path))
    got = models.saved_models(t)
    (lines,) = [p for p in plans if "l_partkey" in p]
    assert 0 <= lines.index("RepartitionByExpression") < lines.index("LeftSemi")
    # Scores are compared in the row, not by a join.
    assert "Join" not in _plan(got)
    want = {"probe": t.vectors.join(t.node_labels, "node").count(), "trees": t.lineitem.select(F.col("l_partkey").alias("node")).distinct().join(t.node_labels, "node").count()}
    assert {r.model: (r.nodes, r.agreeing) for r in got.collect()} == {k: (n, n) for k, n in want.items()}
    assert all(n > 0 for n in want.values())
