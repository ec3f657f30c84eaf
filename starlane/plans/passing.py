"""Message passing over the follow graph with fixed weights, and the core of the graph under ids of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.functions.expr import round_to
from starlane.operators import graph, layers
from starlane.operators.layers import Matrix, Weights
from starlane.plans import registry as r
from starlane.plans.graphs import _RAW, node_ids, raw_features
from starlane.plans.registry import query
from starlane.sources.bindings import Tables

#: What goes in, widths of what comes out of the layers, and neighbours in the last layer and the one before it.
KNOWN, HIDDEN, MOST = ("posts", "replies", "likes", "follows"), 3, (15, 10)
CORE = 4


def matrix(rows: int, columns: int, seed: int) -> Matrix:
    """Weights stand for fitted ones: small numbers of both signs by a rule."""
    return [[((5 * i + 3 * j + seed) % 7 - 3) / 8 for j in range(columns)] for i in range(rows)]


def weights(columns: int, seed: int) -> Weights:
    return Weights(matrix(HIDDEN, columns, seed), [0.125 * (i + 1) for i in range(HIDDEN)], matrix(HIDDEN, columns, seed + 1))


HEAD, HEAD_BIAS = [0.5, -0.25, 0.375], -0.5
FOLLOW, BACK = (weights(len(KNOWN), 1), weights(HIDDEN, 4)), (weights(len(KNOWN), 2), weights(HIDDEN, 6))


def inputs(t: Tables) -> DataFrame:
    return raw_features(t).select("node", F.array(*(F.log1p(c) for c in KNOWN)).alias("x"))


# The same in SQL, as text made of the same weights.
_listed = lambda v: "[" + ", ".join(f"{x}::DOUBLE" if not isinstance(x, list) else _listed(x) for x in v) + "]"
_times = lambda m, v: f"list_transform({_listed(m)}, lambda w: list_dot_product(w, {v}))"


def _sample(edges: str, most: int, seed: int) -> str:
    return f"(SELECT src, dst FROM {edges} QUALIFY row_number() OVER (PARTITION BY dst ORDER BY md5('{seed}:' || src || ':' || dst), src) <= {most})"


def _means(features: str, edges: str, width: int) -> str:
    return f"(SELECT dst AS node, [{', '.join(f'avg(x[{i + 1}])' for i in range(width))}] AS m FROM {edges} e JOIN {features} f ON e.src = f.node GROUP BY 1)"


def _layer(features: str, relations: list[tuple[str, Weights]]) -> str:
    """As layers.layer with sums over relations."""
    width = len(relations[0][1].own[0])
    joins = " ".join(f"LEFT JOIN {_means(features, edges, width)} m{k} ON a.node = m{k}.node" for k, (edges, _) in enumerate(relations))
    terms = [f"{x}[i]" for k, (_, w) in enumerate(relations) for x in (_times(w.neighbours, f"coalesce(m{k}.m, {_listed([0.0] * width)})"), _listed(w.bias), _times(w.own, "a.x"))]
    return f"(SELECT a.node, [{', '.join('greatest(' + ' + '.join(x.replace('[i]', f'[{i + 1}]') for x in terms) + ', 0.0::DOUBLE)' for i in range(HIDDEN))}] AS x FROM {features} a {joins})"


_INPUTS = f"n AS (SELECT node, [{', '.join(f'ln(1.0::DOUBLE + {c})' for c in KNOWN)}] AS x FROM ({_RAW}))"
_EDGES = "e AS (SELECT DISTINCT src, dst FROM {follows}), b AS (SELECT DISTINCT dst AS src, src AS dst FROM {follows})"
_SCORES = f"SELECT node, {r.rnd(f'1 / (1 + exp(-(list_dot_product({_listed(HEAD)}, x) + {HEAD_BIAS}::DOUBLE)))', 5)} AS score, {r.rnd('x[1]', 4)} AS first FROM h2"


def _scores(embedded: DataFrame) -> DataFrame:
    return layers.head(embedded, HEAD, HEAD_BIAS).select("node", round_to(F.col("score"), 5).alias("score"), round_to(F.get("x", 0), 4).alias("first"))


@query("gm13b_two_layers", f"WITH {_INPUTS}, {_EDGES}, s1 AS {_sample('e', MOST[1], 1)}, s2 AS {_sample('e', MOST[0], 2)}, h1 AS {_layer('n', [('s1', FOLLOW[0])])}, h2 AS {_layer('h1', [('s2', FOLLOW[1])])} {_SCORES}")
def two_layers(t: Tables) -> DataFrame:
    """Every node's score after two layers over those that follow it, 15 and 10 of them at most."""
    edges = t.follows.select("src", "dst").distinct()
    return _scores(layers.two_layers(inputs(t), [(edges, *FOLLOW)], MOST))


@query("gm31b_two_relations", f"WITH {_INPUTS}, {_EDGES}, s1 AS {_sample('e', MOST[1], 1)}, s2 AS {_sample('e', MOST[0], 2)}, t1 AS {_sample('b', MOST[1], 1)}, t2 AS {_sample('b', MOST[0], 2)}, h1 AS {_layer('n', [('s1', FOLLOW[0]), ('t1', BACK[0])])}, h2 AS {_layer('h1', [('s2', FOLLOW[1]), ('t2', BACK[1])])} {_SCORES}")
def two_relations(t: Tables) -> DataFrame:
    """The same over two relations, each with matrices of its own, summed over relations in each layer."""
    edges = t.follows.select("src", "dst").distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return _scores(layers.two_layers(inputs(t), [(edges, *FOLLOW), (back, *BACK)], MOST))


@query("gm06b_core_edges")
def core_edges(t: Tables) -> DataFrame:
    """Edges of the peeled core by its own ids, with the ids of both ends in the whole graph; a fixpoint, compared with a plain peel by tests."""
    ids, edges = graph.core_graph(t.follows, CORE, node_ids(t))
    a, b = ids.select(F.col("local").alias("src"), F.col("idx").alias("src_idx")), ids.select(F.col("local").alias("dst"), F.col("idx").alias("dst_idx"))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).join(a, "src").join(b, "dst").select("src", "dst", "src_idx", "dst_idx", "n")
