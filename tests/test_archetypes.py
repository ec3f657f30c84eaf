"""Operators and expressions on rows written by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlane.functions import expr
from starlane.operators import archetypes as ops
from starlane.operators import graph

D = dt.date


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*(cols or df.columns)).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_weeks(spark):
    days = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 2),), (D(2024, 1, 7),), (D(2024, 1, 8),)], "d date").select(expr.week(F.col("d")).alias("iso"), expr.week_before(F.col("d")).alias("compat")).collect()
    assert [r.iso for r in days] == [D(2024, 1, 1)] * 3 + [D(2024, 1, 8)]
    assert [r.compat for r in days] == [D(2023, 12, 25), D(2024, 1, 1), D(2024, 1, 1), D(2024, 1, 1)]


def test_masks(spark):
    m = spark.createDataFrame([(x,) for x in (1, 2, 4, 8, 10, 15)], "m int")
    assert [r.m for r in m.where(expr.has(F.col("m"), expr.POST)).collect()] == [1, 15]
    assert [r.m for r in m.where(expr.has(F.col("m"), expr.FOLLOW)).collect()] == [8, 10, 15]
    assert m.where("m = 4").select(F.sum(expr.flag(expr.has(F.col("m"), expr.REPOST))).alias("s")).first().s == 1


def test_size_buckets(spark):
    n = [0, 1, 5, 6, 10, 11, 100, 101, 500, 501, 1000, 1001]
    got = [r.b for r in spark.createDataFrame([(x,) for x in n], "n long").select(expr.size_bucket(F.col("n")).alias("b")).collect()]
    assert got == ["0", "1", "2-5", "6-10", "6-10", "11-50", "51-100", "101-500", "101-500", "501-1K", "501-1K", "1K+"]


@pytest.mark.parametrize(("url", "public"), [("https://a.b", True), ("https://localhost", False), ("ftp://a.b", False), ("https://nodot", False), ("https://x.local:8080", False), ("http://10.0.0.1", False), ("https://example.com", False), ("https://" + "a" * 200 + ".b", False)])
def test_public_host(spark, url, public):
    assert one(spark, expr.public_host(F.lit(url))) == public


def test_providers(spark):
    got = [one(spark, expr.provider(F.lit(x).cast("string"))) for x in (None, "", "Amazon AWS", "HETZNER-AS", "Nobody")]
    assert got == ["Unknown", "Unknown", "AWS", "Hetzner", "Nobody"]


def test_round(spark):
    got = [one(spark, expr.round_to(F.lit(x), n)) for x, n in ((0.285, 2), (1.005, 2), (2.5, 0), (-2.5, 0))]
    assert got == [np.floor(0.285 * 100 + 0.5) / 100, np.floor(1.005 * 100 + 0.5) / 100, 3.0, -2.0]
    assert one(spark, expr.percent(F.lit(1), F.lit(0))) is None


def test_latest_and_ties(spark):
    df = spark.createDataFrame([("a", "https://a/", 3), ("a", "https://a", 3), ("b", "x", 1), ("b", "x", 0)], "k string, url string, d int")
    assert ops.latest_per_key(df, ["k"], [F.desc("d")], ties=True).count() == 3
    assert values(ops.latest_per_key(df, ["k"], [F.desc("d"), F.col("url")])) == [("a", "https://a", 3), ("b", "x", 1)]


def test_fallback(spark):
    df = spark.createDataFrame([("h", 1, "v1", None, "X"), ("h", 2, None, 4.0, None), ("h", 3, None, None, None)], "k string, d int, v string, lat double, org string")
    got = ops.composite_fallback(df, ["k"], "d", [["v"], ["lat", "org"]]).first()
    assert (got.d, got.v, got.lat, got.org) == (3, "v1", 4.0, None)


def test_totals_over_nothing(spark):
    df = spark.createDataFrame([], "k string, n int")
    got = ops.with_total(df, ["k"], [F.count("*").alias("c")], {"k": "~"})
    assert values(got, "k", "c") == [("~", 0)]


def test_top_else_other(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), (None, 1)], "k string, n int")
    assert values(ops.topn_else_other(df, "k", "n", 2)) == [("Other", 1), ("Other", 3), ("a", 5), ("b", 3)]


def test_trailing_distinct_against_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(D(2024, 1, 1) + dt.timedelta(int(d)), int(u)) for d, u in zip(rng.integers(0, 20, 60), rng.integers(0, 9, 60), strict=True)]
    want = sorted((d, len({u for e, u in rows if 0 <= (d - e).days < 5})) for d in {d for d, _ in rows})
    df = ops.trailing_distinct(spark.createDataFrame(rows, "d date, u int"), "d", "u", 5)
    assert values(df, "d", "users") == want
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_retention_and_activation(spark):
    start = D(2024, 1, 1)
    cohort = spark.createDataFrame([(u, start) for u in range(7)], "u int, c date")
    seen = spark.createDataFrame([(u, start + dt.timedelta(n)) for u, n in enumerate((0, 1, 6, 7, 27, 28))], "u int, d date")
    got = {r.u: r for r in ops.day_n_retention(cohort, seen, "u", "c", "d", [1, 7]).collect()}
    assert [(r.d1, r.d7) for _, r in sorted(got.items())] == [(0, 0), (1, 0), (0, 0), (0, 1), (0, 0), (0, 0), (0, 0)]
    first = {r.u: r.first_active for r in ops.within_n_days(cohort, seen, "u", "c", "d", 28).collect()}
    assert [first[u] is not None for u in range(7)] == [True] * 5 + [False] * 2


def test_changes_and_hops(spark):
    rows = [(1, 1, "A"), (1, 2, "A"), (1, 3, "B"), (1, 4, "A"), (2, 1, "C")]
    got = ops.detect_changes(spark.createDataFrame(rows, "k int, t int, h string"), "k", ["t"], "h")
    assert values(got, "k", "t", "h") == [(1, 1, "A"), (1, 3, "B"), (1, 4, "A"), (2, 1, "C")]
    moves = ops.hops(got.where("before is not null"), "k", ["t"])
    assert values(moves, "step", "before", "h") == [(0, "A", "B"), (1, "B", "A")]


def test_merge_replays(spark):
    schema = "k int, n long, m int, f string, l string, c string"
    old, new = spark.createDataFrame([(1, 5, 1, "a", "a", "a")], schema), spark.createDataFrame([(1, 2, 2, "b", "b", None), (2, 1, 4, "z", "z", "z")], schema)
    how = {"n": "add", "m": "or", "f": "first", "l": "last", "c": "coalesce"}
    once = ops.merge(old, new, ["k"], how)
    assert values(once) == [(1, 7, 3, "a", "b", "a"), (2, 1, 4, "z", "z", "z")]
    assert values(ops.merge(once, new, ["k"], how)) == [(1, 9, 3, "a", "b", "a"), (2, 2, 4, "z", "z", "z")]


def test_rank_metrics(spark):
    df = spark.createDataFrame([(1, 4.0, True), (2, 3.0, False), (3, 2.0, True), (4, 1.0, False)], "id int, s double, h boolean")
    assert values(ops.rank_metrics(df, "s", "h", "id", [2])) == [(2, 0.5, 0.5, 1.0)]


def test_discovery_ranking_finds_hot_clusters(spark):
    """A made-up population with three hot clusters: ranking by score must lift the hits, and the hot clusters lead."""
    u = lambda seed: expr.uniform(F.col("id"), seed)
    pop = spark.range(6000).select("id", F.floor(u(1) * 60).cast("int").alias("cluster"), u(2).alias("latent"))
    pop = pop.withColumn("hot", F.col("cluster").isin(7, 42, 55)).withColumn("hit", u(3) < F.when(F.col("hot"), 0.15).otherwise(0.001) * (0.3 + F.col("latent")))
    pop = pop.withColumn("s", 0.6 * F.col("hot").cast("int") + 0.4 * F.col("latent") + 0.1 * u(4))
    assert ops.rank_metrics(pop, "s", "hit", "id", [100]).first().lift > 3
    top = pop.groupBy("cluster").agg(F.avg(F.col("hit").cast("int")).alias("r")).orderBy(F.desc("r")).limit(3).collect()
    assert {r.cluster for r in top} == {7, 42, 55}


def brute_core(edges, k):
    edges = list(edges)
    while True:
        degree = {}
        for a, b in edges:
            degree[a] = degree.get(a, 0) + 1
            degree[b] = degree.get(b, 0) + 1
        left = [(a, b) for a, b in edges if degree[a] >= k and degree[b] >= k]
        if len(left) == len(edges):
            return sorted(edges)
        edges = left


def test_k_core(spark):
    assert values(graph.k_core(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long"), 2)) == [(1, 2), (2, 3), (3, 1)]
    rng = np.random.default_rng(4)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 40, (120, 2))]
    assert values(graph.k_core(spark.createDataFrame(edges, "src long, dst long"), 5)) == brute_core(edges, 5)


def test_node_ids_are_contiguous(spark):
    ids = values(graph.node_ids(spark.range(500).selectExpr("concat('n', id % 137) as n"), "n"))
    assert [i for _, i in sorted(ids)] == list(range(137)) and [n for n, _ in ids] == sorted(n for n, _ in ids)


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (2, 1)], "src long, dst long")
    assert values(graph.reachable(edges, spark.createDataFrame([(1,)], "node long"), 3)) == [(1, 0), (2, 1), (3, 2), (4, 3)]


def test_clusters_and_probe(spark):
    from starlane.operators import learn

    rng = np.random.default_rng(0)
    rows = [(i, i % 3, [float(x) for x in rng.normal(10 * (i % 3), 0.1, 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, c int, v array<double>")
    assert learn.clusters(df, "v", 3).select("c", "assigned").distinct().count() == 3
    labelled = df.withColumn("y", (F.col("c") == 2).cast("int"))
    p = learn.linear_probe(labelled, labelled, "v", "y").collect()
    assert all((r.probability > 0.5) == (r.c == 2) for r in p)


def test_boosted_trees_on_rows_not_seen(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), int(a * b > 0)) for a, b in rng.normal(size=(600, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    from starlane.operators import learn

    got = learn.boosted_trees(df.limit(400), df.subtract(df.limit(400)), ["a", "b"], "y").collect()
    assert len(got) >= 190 and sum((r.probability >= 0.5) == bool(r.y) for r in got) > 0.85 * len(got)


def test_ranked_sums_over_partitions(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = {r.id: (r.rank, r.upto) for r in graph.ranked(rows, [F.desc("id")], "rank", {"upto": "v"}).collect()}
    total = 0
    for rank, i in enumerate(range(499, -1, -1), 1):
        total += i % 7
        assert got[i] == (rank, total)


@pytest.mark.parametrize(("url", "public"), [("https://a.host.net", True), ("ftp://a.net", False), ("https://nodots", False), ("https://x.local", False), ("https://x.local.net", True), ("https://x.test:80", False), ("http://core.network", False), ("https://a.core.network", True), ("https://10x0.0.1.net", True), ("https://" + "a" * 200 + ".net", False)])
def test_public_hosts(spark, url, public):
    assert one(spark, expr.public_host(F.lit(url))) is public


def test_null_aware_anti(spark):
    def kept(keys, others):
        df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
        return sorted(r.i for r in ops.null_aware_anti(df, spark.createDataFrame([(o,) for o in others], "k string"), "k").collect())

    assert kept(["a", "b", None, "b"], []) == [0, 1, 2, 3]
    assert kept(["a", "b", None, "b"], ["a", "a"]) == [1, 3]
    assert kept(["a", "b", None, "b"], ["a", None]) == []
    assert kept([], ["a"]) == []


def test_focal_loss(spark):
    from starlane.plans.choices import focal_loss

    rows = [(0.9, True), (0.9, False), (0.2, True), (0.5, False)]
    df = spark.createDataFrame(rows, "p double, hit boolean")
    for gamma in (0.0, 2.0):
        got = [r.v for r in df.select(focal_loss(F.col("p"), F.col("hit"), gamma, 3.0).alias("v")).collect()]
        want = [(3 if hit else 1) * -math.log(p if hit else 1 - p) * ((1 - p) if hit else p) ** gamma for p, hit in rows]
        assert got == pytest.approx(want)


def test_eras_take_whole_months(spark):
    from starlane.plans.choices import era

    days = {"2022-12-31": "Pre-2023", "2023-01-01": "2023", "2024-10-31": "2024 pre-Nov", "2024-11-01": "2024 Nov–Dec", "2025-06-30": "2025 H1", "2026-01-01": "2026+", None: None}
    got = spark.createDataFrame([(d,) for d in days], "d string").select("d", era(F.col("d")).alias("e")).collect()
    assert {r.d: r.e for r in got} == days
