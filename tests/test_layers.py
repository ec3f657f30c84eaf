"""Message passing against numpy, hubs, the core against a plain peel, allocation, the directory, and models as artefacts."""

import hashlib
import json
import tempfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlane.operators import graph, layers, learn
from starlane.operators.archetypes import allocate
from starlane.operators.layers import Weights
from starlane.plans.places import directory


def values(df):
    return sorted(tuple(r) for r in df.collect())


def plain_sample(edges, most, seed):
    by = defaultdict(set)
    for s, d in edges:
        by[d].add(s)
    return {d: sorted(ss, key=lambda s: (hashlib.md5(f"{seed}:{s}:{d}".encode()).hexdigest(), s))[:most] for d, ss in by.items()}


def plain_layer(x, relations, across):
    out = {}
    for node, own in x.items():
        parts = []
        for sample, w in relations:
            around = [x[s] for s in sample.get(node, []) if s in x]
            mean = np.mean(around, axis=0) if around else np.zeros(len(own))
            parts.append(np.array(w.neighbours) @ mean + np.array(w.bias) + np.array(w.own) @ own)
        z = {"sum": np.sum, "mean": np.mean, "max": np.max}[across](parts, axis=0)
        out[node] = np.maximum(z, 0)
    return out


@pytest.mark.parametrize("across", ["sum", "mean", "max"])
def test_two_layers_over_two_relations(spark, across):
    rng = np.random.default_rng(3)
    edges = [[(int(a), int(b)) for a, b in rng.integers(0, 30, (n, 2))] for n in (220, 60)]
    x = {i: rng.normal(0, 1, 4) for i in range(30)}
    w = lambda rows, columns: Weights(rng.normal(0, 1, (rows, columns)).tolist(), rng.normal(0, 1, rows).tolist(), rng.normal(0, 1, (rows, columns)).tolist())
    both = [(w(5, 4), w(3, 5)) for _ in edges]
    want = plain_layer(x, [(plain_sample(e, 4, "1"), a) for e, (a, _) in zip(edges, both, strict=True)], across)
    want = plain_layer(want, [(plain_sample(e, 6, "2"), b) for e, (_, b) in zip(edges, both, strict=True)], across)
    features = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "node long, x array<double>")
    frames = [(spark.createDataFrame(e, "src long, dst long"), a, b) for e, (a, b) in zip(edges, both, strict=True)]
    got = {r.node: r.x for r in layers.two_layers(features, frames, (6, 4), across).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_a_hub_is_sampled_before_the_shuffle(spark):
    two = spark.range(20_000).select(F.col("id").alias("src"), (-1 - F.col("id") % 2).alias("dst")).repartition(8)
    found = layers.sampled(two, 15)
    assert found._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2  # one on either side of the exchange
    want = plain_sample([(i, -1 - i % 2) for i in range(20_000)], 15, "")
    assert values(found) == sorted((s, d) for d, ss in want.items() for s in ss)
    features = spark.range(-2, 20_000).select(F.col("id").alias("node"), F.array(F.col("id").cast("double")).alias("x"))
    w = Weights([[1.0]], [0.5], [[0.0]])
    assert {r.node: r.x[0] for r in layers.layer(features, [(found, w)]).where("node < 1").collect()} == {-1: pytest.approx(np.mean(want[-1]) + 0.5), -2: pytest.approx(np.mean(want[-2]) + 0.5), 0: 0.5}


def peel(edges, k):
    alive = list(edges)
    while True:
        degree = Counter(x for e in alive for x in e)
        left = [e for e in alive if degree[e[0]] >= k and degree[e[1]] >= k]
        if len(left) == len(alive):
            return left
        alive = left


def test_core_ids_against_a_plain_peel(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a) * 10, int(b) * 10) for a, b in rng.integers(0, 60, (200, 2))] + [(1000, 10), (10, 20), (10, 20)]
    nodes = sorted({x for e in edges for x in e})
    core = peel(edges, 5)
    inside = sorted({x for e in core for x in e})
    assert 0 < len(inside) < len(nodes)
    ids, found = graph.core_graph(spark.createDataFrame(edges, "src long, dst long"), 5)
    assert values(ids.select("node", "idx", "local")) == [(n, nodes.index(n), inside.index(n)) for n in inside]
    assert values(found) == sorted((inside.index(a), inside.index(b)) for a, b in core)
    ids, found = graph.core_graph(spark.createDataFrame(edges, "src long, dst long"), 99)
    assert ids.count() == found.count() == 0


def test_amounts_are_spread_whole(spark):
    places = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("g", "c", 4), ("h", "d", 5), ("h", "e", 0), ("none", "f", 1)], "group string, place string, w long")
    rows = spark.createDataFrame([("g", "x", 10), ("g", "y", 0), ("g", "z", 1), ("h", "x", 3), ("lost", "x", 8)], "group string, key string, n long")
    even = allocate(rows, places.drop("w"), "group", ["key"], "n", "place")
    assert values(even.where("group = 'g'").select("key", "place", "n")) == [("x", "a", 4), ("x", "b", 3), ("x", "c", 3), ("y", "a", 0), ("y", "b", 0), ("y", "c", 0), ("z", "a", 1), ("z", "b", 0), ("z", "c", 0)]
    # 10/7, 20/7 and 40/7: whole parts 1, 2 and 5, and the two left go to .86 and .71.
    weighed = allocate(rows, places, "group", ["key"], "n", "place", "w")
    assert values(weighed.where("key = 'x'").select("place", "n")) == [("a", 1), ("b", 3), ("c", 6), ("d", 3)]


def test_a_directory_has_defaults(spark):
    text = [json.dumps({"hosts": {"https://a": {"version": "1", "inviteCodeRequired": True, "status": "online", "more": [1]}, "https://b": {}, "https://c": {"status": "offline", "version": None}, "https://d": None}}), "{", '{"hosts":{}}', "[]"]
    rows = directory(spark.createDataFrame([(x,) for x in text], "value string"))
    assert values(rows.select("url", F.coalesce("version", F.lit("-")), "invite_required", "is_online")) == [("https://a", "1", True, True), ("https://b", "-", False, False), ("https://c", "-", False, False), ("https://d", "-", False, False)]


def test_models_score_the_same_in_another_session(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), int(a + 0.3 * b > 0.2)) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))]
    df = spark.createDataFrame(rows, "node long, a double, b double, bad int")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    model = learn.fitted_trees(df, ["a", "b"], "bad", rounds=3)
    for _ in range(2):
        learn.save_model(model, f"{folder}/trees")
    other = spark.newSession()
    again = learn.load_model(f"{folder}/trees", other)
    want = values(learn.scored(model, df).select("node", "probability"))
    assert values(learn.scored(again, other.createDataFrame(rows, df.schema)).select("node", "probability")) == want
    assert len({p for _, p in want}) > 2
