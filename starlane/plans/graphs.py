"""The graph and ranking side: ids, projections, cores, features, masks, cluster enrichment, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.functions.expr import flag, percent, round_to, uniform
from starlane.operators import graph
from starlane.operators.archetypes import latest_per_key, rank_metrics
from starlane.plans import registry as r
from starlane.plans.registry import query
from starlane.sources.bindings import Tables

CUTOFF = "2024-01-20"
LEAST_CLUSTER = 8
#: Centroids that a vector is compared with at a time.
BLOCK = 256


@query("gm01_node_ids", "SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM {follows} UNION SELECT dst FROM {follows})")
def node_ids(t: Tables) -> DataFrame:
    return graph.node_ids(t.follows.select(F.explode(F.array("src", "dst")).alias("node")), "node")


@query("gm02_edges", "WITH n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM {follows} UNION SELECT dst FROM {follows})) SELECT a.idx AS src, b.idx AS dst, count(*) AS n FROM {follows} f JOIN n a ON f.src = a.node JOIN n b ON f.dst = b.node GROUP BY 1, 2")
def edges(t: Tables) -> DataFrame:
    return graph.remap(t.follows, node_ids(t), "node").groupBy("src", "dst").agg(F.count("*").alias("n"))


_SPEAKER = "CAST(floor({0}.conv_id / 4.0) AS BIGINT) * 3 + CASE {0}.role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END"


@query("gm03_reply_projection", f"SELECT DISTINCT {_SPEAKER.format('a')} AS src, {_SPEAKER.format('b')} AS dst FROM {{conversations}} a JOIN {{conversations}} b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role <> b.role")
def reply_projection(t: Tables) -> DataFrame:
    """Each reply points at who wrote the turn before it (a speaker takes part in four conversations); one window instead of a self join."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    speaker = lambda role: F.floor(F.col("conv_id") / 4) * 3 + F.when(role == "user", 0).when(role == "assistant", 1).otherwise(2)
    rows = t.conversations.select("conv_id", "turn", "role").withColumns({"p": F.lag("role").over(w), "q": F.lag("turn").over(w)}).where((F.col("q") == F.col("turn") - 1) & (F.col("p") != F.col("role")))
    return rows.select(speaker(F.col("role")).alias("src"), speaker(F.col("p")).alias("dst")).where("src <> dst").distinct()


@query("gm04_symmetric", "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {follows} UNION ALL SELECT dst, src FROM {follows}) WHERE src <> dst")
def symmetric(t: Tables) -> DataFrame:
    return graph.symmetric(t.follows)


@query("gm05_k_core")
def k_core(t: Tables) -> DataFrame:
    """A fixpoint; tests compare it with a plain peel."""
    return graph.degrees(graph.k_core(t.follows, 4))


@query("gm05b_degree_filter", "WITH d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {follows} UNION ALL SELECT dst FROM {follows}) GROUP BY 1 HAVING count(*) >= 4) SELECT node, degree FROM d")
def degree_filter(t: Tables) -> DataFrame:
    return graph.degrees(t.follows).where("degree >= 4")


_RAW = "SELECT l_suppkey AS node, count(*) AS posts, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS replies, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS likes, count(DISTINCT l_orderkey) AS follows FROM {lineitem} GROUP BY 1"


def raw_features(t: Tables) -> DataFrame:
    is_ = lambda f: F.sum(flag(F.col("l_returnflag") == f))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").alias("posts"), is_("R").alias("replies"), is_("A").alias("likes"), F.count_distinct("l_orderkey").alias("follows"))


@query(
    "gm08_tabular_features",
    f"WITH f AS ({_RAW}) SELECT node, {r.rnd('ln(1 + posts)', 6)} AS log_posts, {r.rnd('replies / (posts + 1.0::DOUBLE)', 6)} AS reply_ratio, {r.rnd('least(likes / (follows + 1.0::DOUBLE), 10.0::DOUBLE)', 6)} AS like_ratio, {r.rnd('ln(1 + follows)', 6)} AS log_follows FROM f",
)
def tabular_features(t: Tables) -> DataFrame:
    """Logs, ratios against division by zero, clipped."""
    c, one = F.col, F.lit(1.0)
    return raw_features(t).select("node", round_to(F.log1p("posts"), 6).alias("log_posts"), round_to(c("replies") / (c("posts") + one), 6).alias("reply_ratio"), round_to(F.least(c("likes") / (c("follows") + one), F.lit(10.0)), 6).alias("like_ratio"), round_to(F.log1p("follows"), 6).alias("log_follows"))


@query("gm07_scaled_features", f"WITH f AS ({_RAW}), s AS (SELECT avg(posts) AS m, stddev_pop(posts) AS sd, avg(likes) AS lm, stddev_pop(likes) AS ls FROM f) SELECT node, {r.rnd('(posts - m) / nullif(sd, 0)', 4)} AS posts_z, {r.rnd('(likes - lm) / nullif(ls, 0)', 4)} AS likes_z FROM f, s")
def scaled_features(t: Tables) -> DataFrame:
    f = raw_features(t)
    s = f.agg(F.avg("posts").alias("m"), F.stddev_pop("posts").alias("sd"), F.avg("likes").alias("lm"), F.stddev_pop("likes").alias("ls"))
    z = lambda x, m, sd: round_to((F.col(x) - F.col(m)) / F.nullif(F.col(sd), F.lit(0.0)), 4)
    return f.crossJoin(F.broadcast(s)).select("node", z("posts", "m", "sd").alias("posts_z"), z("likes", "lm", "ls").alias("likes_z"))


_UNIFORM = "('0x' || substr(md5('42:' || node), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(
    "gm09_split_masks",
    f"SELECT split, count(*) AS n, {r.long_sum('bad')} AS positives FROM (SELECT bad, CASE WHEN bad AND first_labeled >= DATE '{CUTOFF}' THEN 'test' WHEN bad THEN 'train' WHEN {_UNIFORM} < 0.70 THEN 'train' WHEN {_UNIFORM} < 0.85 THEN 'valid' ELSE 'test' END AS split FROM {{node_labels}}) GROUP BY 1",
)
def split_masks(t: Tables) -> DataFrame:
    """Positives by date, so that nothing from after the cutoff is learned; negatives by a hash of the id."""
    late, u = F.col("first_labeled") >= F.lit(CUTOFF).cast("date"), uniform(F.col("node"))
    split = F.when(F.col("bad") & F.coalesce(late, F.lit(False)), "test").when(F.col("bad"), "train").when(u < 0.70, "train").when(u < 0.85, "valid").otherwise("test")
    return t.node_labels.withColumn("split", split).groupBy("split").agg(F.count("*").alias("n"), F.sum(flag(F.col("bad"))).alias("positives"))


@query("gm10_strict_masks", f"SELECT {r.long_sum(f'bad AND first_labeled <= DATE {chr(39)}{CUTOFF}{chr(39)}')} AS known, {r.long_sum(f'bad AND first_labeled > DATE {chr(39)}{CUTOFF}{chr(39)}')} AS future, {r.long_sum(f'NOT (bad AND first_labeled <= DATE {chr(39)}{CUTOFF}{chr(39)})')} AS candidates FROM {{node_labels}}")
def strict_masks(t: Tables) -> DataFrame:
    at = F.lit(CUTOFF).cast("date")
    known = F.col("bad") & (F.col("first_labeled") <= at)
    return t.node_labels.agg(F.sum(flag(known)).alias("known"), F.sum(flag(F.col("bad") & (F.col("first_labeled") > at))).alias("future"), F.sum(flag(~known)).alias("candidates"))


@query(
    "gm11_label_union",
    "WITH u AS (SELECT did, labeled, 'label' AS source, 1 AS priority FROM {account_labels} WHERE label = 'spam' UNION ALL SELECT s.did, max(a.dt), 'takedown', 2 FROM {repo_status} s LEFT JOIN {activity} a ON s.did = a.did WHERE status = 'takendown' GROUP BY 1) SELECT did, min(labeled) AS first_labeled, arg_min(source, priority) AS source, count(*) AS sources FROM u GROUP BY 1",
)
def label_union(t: Tables) -> DataFrame:
    """All sources of labels, the first date of any, and the source that ranks first; takedowns are dated by the last day active."""
    last = t.activity.groupBy("did").agg(F.max("dt").alias("labeled"))
    taken = t.repo_status.where("status = 'takendown'").join(last, "did", "left").select("did", "labeled", F.lit("takedown").alias("source"), F.lit(2).alias("priority"))
    u = t.account_labels.where("label = 'spam'").select("did", "labeled", F.lit("label").alias("source"), F.lit(1).alias("priority")).unionByName(taken)
    return u.groupBy("did").agg(F.min("labeled").alias("first_labeled"), F.min_by("source", "priority").alias("source"), F.count("*").alias("sources"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score(v: Column) -> Column:
    """A linear score with fixed weights, through the logistic function, in six decimals."""
    z = F.aggregate(F.transform(v.cast("array<double>"), lambda x, i: x * (F.pmod(i, F.lit(5)) - 2)), F.lit(0.0), lambda s, x: s + x)
    return round_to(1.0 / (1.0 + F.exp(-z)), 6)


_Z = "list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i - 1) % 5 - 2)))"
_SCORE = r.rnd(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-({_Z})))", 6)


@query("gm17_linear_score", f"SELECT node, {_SCORE} AS score FROM {{vectors}}")
def linear_score(t: Tables) -> DataFrame:
    return t.vectors.select("node", score(F.col("embedding")).alias("score"))


_ASSIGNED = "(SELECT v.node, cluster, coalesce(bad, false) AS bad, first_labeled FROM {vectors} v LEFT JOIN {node_labels} l ON v.node = l.node)"
# Edges by what an order line ties together: as many as there are lines, over all ids.
_PAIRS = "(SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM {lineitem} WHERE l_partkey <> l_suppkey)"


def assigned(t: Tables) -> DataFrame:
    return t.vectors.select("node", "cluster").join(t.node_labels, "node", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))


def pairs(t: Tables) -> DataFrame:
    return t.lineitem.where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query("gm18_intra_cluster_edges", f"SELECT a.cluster, count(*) AS intra FROM {_PAIRS} p JOIN {_ASSIGNED} a ON p.src = a.node JOIN {_ASSIGNED} b ON p.dst = b.node WHERE a.cluster = b.cluster GROUP BY 1")
def intra_cluster_edges(t: Tables) -> DataFrame:
    at = t.vectors.select("node", "cluster")
    rows = pairs(t).join(at.select(F.col("node").alias("src"), "cluster"), "src").join(at.select(F.col("node").alias("dst"), F.col("cluster").alias("other")), "dst")
    return rows.where("cluster = other").groupBy("cluster").agg(F.count("*").alias("intra"))


_CLUSTERS = f"WITH a AS {_ASSIGNED}, e AS (SELECT x.cluster, count(*) AS intra FROM {_PAIRS} p JOIN a x ON p.src = x.node JOIN a y ON p.dst = y.node WHERE x.cluster = y.cluster GROUP BY 1), g AS (SELECT cluster, count(*) AS size, {r.long_sum('bad')} AS bad FROM a GROUP BY 1), b AS (SELECT 1.0::DOUBLE * {r.long_sum('bad')} / count(*) AS base FROM a)"
_ENRICH = "(1.0::DOUBLE * bad / size) / nullif(base, 0)"


@query("gm19_cluster_ranking", f"{_CLUSTERS} SELECT cluster, size, bad, coalesce(intra, 0) AS intra, {r.rnd(_ENRICH, 4)} AS enrichment, {r.rnd(f'{_ENRICH} * ln(1 + coalesce(intra, 0) / (1.0::DOUBLE * size))', 4)} AS score FROM g LEFT JOIN e USING (cluster), b WHERE size >= {LEAST_CLUSTER}")
def cluster_ranking(t: Tables) -> DataFrame:
    """Enrichment in labelled members against all, times the log of edges inside for each member."""
    a = assigned(t)
    g = a.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(flag(F.col("bad"))).alias("bad")).where(F.col("size") >= LEAST_CLUSTER).join(intra_cluster_edges(t), "cluster", "left").withColumn("intra", F.coalesce("intra", F.lit(0)))
    base = a.agg((F.sum(flag(F.col("bad"))) / F.count("*")).alias("base"))
    enrich = (F.col("bad") / F.col("size")) / F.nullif(F.col("base"), F.lit(0.0))
    return g.crossJoin(F.broadcast(base)).select("cluster", "size", "bad", "intra", round_to(enrich, 4).alias("enrichment"), round_to(enrich * F.log1p(F.col("intra") / F.col("size")), 4).alias("score"))


_SPLIT = f"(SELECT cluster, v.node, coalesce(bad AND first_labeled < DATE '{CUTOFF}', false) AS known, coalesce(bad AND first_labeled >= DATE '{CUTOFF}', false) AS future, coalesce(NOT bad, false) AS excluded FROM {{vectors}} v LEFT JOIN {{node_labels}} l ON v.node = l.node)"


@query(
    "gm20_known_enrichment",
    f"""WITH s AS {_SPLIT}, b AS (SELECT 1.0::DOUBLE * {r.long_sum('known')} / nullif({r.long_sum('NOT excluded')}, 0) AS base FROM s)
    SELECT cluster, count(*) AS size, {r.long_sum('known')} AS known, {r.long_sum('NOT excluded AND NOT known')} AS candidates, {r.long_sum('future')} AS future,
    {r.rnd(f"(1.0::DOUBLE * {r.long_sum('known')} / count(*)) / max(base)", 4)} AS known_enrichment, {r.rnd(f"{r.long_sum('future')} / greatest({r.long_sum('NOT excluded AND NOT known')}, 1.0::DOUBLE)", 4)} AS future_rate FROM s, b GROUP BY 1""",
)
def known_enrichment(t: Tables) -> DataFrame:
    """Clusters by what was known at the cutoff only: how much richer in known members than all, and, for what it is worth later, the share of their candidates that came to be known after it."""
    late = F.col("first_labeled") >= F.lit(CUTOFF).cast("date")
    no = lambda c: F.coalesce(c, F.lit(False))
    rows = t.vectors.select("cluster", "node").join(t.node_labels, "node", "left").select("cluster", no(F.col("bad") & ~late).alias("known"), no(F.col("bad") & late).alias("future"), no(~F.col("bad")).alias("excluded"))
    n = lambda c: F.sum(flag(c))
    open_ = ~F.col("excluded") & ~F.col("known")
    base = rows.agg((n(F.col("known")) / F.nullif(n(~F.col("excluded")), F.lit(0))).alias("base"))
    by = rows.groupBy("cluster").agg(F.count("*").alias("size"), n(F.col("known")).alias("known"), n(open_).alias("candidates"), n(F.col("future")).alias("future")).crossJoin(F.broadcast(base))
    enrichment = (F.col("known") / F.col("size")) / F.col("base")
    return by.select("cluster", "size", "known", "candidates", "future", round_to(enrichment, 4).alias("known_enrichment"), round_to(F.col("future") / F.greatest(F.col("candidates").cast("double"), F.lit(1.0)), 4).alias("future_rate"))


@query("so11_cluster_members", f"WITH s AS (SELECT a.node, a.cluster, bad, {_SCORE} AS score FROM {_ASSIGNED} a JOIN {{vectors}} v ON a.node = v.node) SELECT cluster, bad, node, score FROM s QUALIFY row_number() OVER (PARTITION BY cluster, bad ORDER BY score DESC, node) <= CASE WHEN bad THEN 2 ELSE 3 END")
def cluster_members(t: Tables) -> DataFrame:
    """The best members of each cluster, with a quota for labelled and one for others."""
    rows = assigned(t).join(linear_score(t), "node")
    rank = F.row_number().over(Window.partitionBy("cluster", "bad").orderBy(F.desc("score"), "node"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("bad"), 2).otherwise(3)).select("cluster", "bad", "node", "score")


_RANKED = f"(SELECT v.node, {_SCORE} AS score, coalesce(bad, false) AS hit FROM {{vectors}} v LEFT JOIN {{node_labels}} l ON v.node = l.node)"


def scored(t: Tables) -> DataFrame:
    return linear_score(t).join(t.node_labels, "node", "left").select("node", "score", F.coalesce("bad", F.lit(False)).alias("hit"))


KS = [10, 50, 100]


@query(
    "gm22_precision_recall_lift",
    f"WITH s AS {_RANKED}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, node) AS rank FROM s), t AS (SELECT count(*) AS n, {r.long_sum('hit')} AS hits FROM s), f AS (SELECT k, {r.long_sum('hit')} AS found, count(*) AS seen FROM k, (VALUES (10), (50), (100)) v(k) WHERE rank <= k GROUP BY 1) SELECT k, {r.rnd('1.0::DOUBLE * found / seen', 6)} AS precision, {r.rnd('1.0::DOUBLE * found / nullif(hits, 0)', 6)} AS recall, {r.rnd('(1.0::DOUBLE * found / seen) / nullif(1.0::DOUBLE * hits / n, 0)', 6)} AS lift FROM f, t",
)
def precision_recall_lift(t: Tables) -> DataFrame:
    out = rank_metrics(scored(t), "score", "hit", "node", KS)
    return out.select("k", *(round_to(F.col(c), 6).alias(c) for c in ("precision", "recall", "lift")))


@query(
    "gm23_roc_auc",
    f"WITH s AS {_RANKED}, g AS (SELECT score, count(*) AS n, {r.long_sum('hit')} AS p FROM s GROUP BY 1), c AS (SELECT *, coalesce(sum(n - p) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n - p) AS BIGINT) AS negatives, {r.rnd('sum(p * (below + (n - p) / 2.0::DOUBLE)) / nullif(sum(p) * sum(n - p), 0)', 6)} AS auc FROM c",
)
def roc_auc(t: Tables) -> DataFrame:
    """Over distinct scores: each positive beats the negatives below it, and half of those that tie."""
    g = scored(t).groupBy("score").agg(F.count("*").alias("n"), F.sum(flag(F.col("hit"))).alias("p"))
    neg = F.col("n") - F.col("p")
    c = graph.ranked(g.withColumn("neg", neg), [F.col("score")], "rank", {"upto": "neg"}).withColumn("below", F.col("upto") - F.col("neg"))
    won = F.sum(F.col("p") * (F.col("below") + neg / 2.0))
    return c.agg(F.sum("p").alias("positives"), F.sum(neg).alias("negatives"), round_to(won / F.nullif(F.sum("p") * F.sum(neg), F.lit(0)), 6).alias("auc"))


@query(
    "gm23b_average_precision",
    f"WITH s AS {_RANKED}, k AS (SELECT hit, row_number() OVER (ORDER BY score DESC, node) AS rank, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (ORDER BY score DESC, node ROWS UNBOUNDED PRECEDING) AS found FROM s) SELECT {r.rnd('avg(1.0::DOUBLE * found / rank)', 6)} AS average_precision, count(*) AS positives FROM k WHERE hit",
)
def average_precision(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("h", flag(F.col("hit")))
    k = graph.ranked(rows, [F.desc("score"), F.col("node")], "rank", {"found": "h"}).where("hit")
    return k.agg(round_to(F.avg(F.col("found") / F.col("rank")), 6).alias("average_precision"), F.count("*").alias("positives"))


@query(
    "gm28_reachable",
    "WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {follows}), w(node, d) AS (SELECT min(src), 0 FROM e UNION SELECT e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < 3) SELECT node, min(d) AS distance FROM w GROUP BY 1",
)
def reachable(t: Tables) -> DataFrame:
    """Everything within three steps of the first node."""
    edges_ = t.follows.select("src", "dst").distinct()
    return graph.reachable(edges_, edges_.agg(F.min("src").alias("node")), 3)


@query(
    "gm29_flow_shares",
    f"WITH f AS (SELECT from_host AS source, to_host AS target, count(*) AS value FROM {{migrations}} GROUP BY 1, 2) SELECT source, target, value, CAST(sum(value) OVER (PARTITION BY source) AS BIGINT) AS outflow, CAST(sum(value) OVER (PARTITION BY target) AS BIGINT) AS inflow, {r.pct('value', 'sum(value) OVER (PARTITION BY source)', 1)} AS pct_of_outflow FROM f",
)
def flow_shares(t: Tables) -> DataFrame:
    f = t.migrations.groupBy(F.col("from_host").alias("source"), F.col("to_host").alias("target")).agg(F.count("*").alias("value"))
    out = F.sum("value").over(Window.partitionBy("source"))
    return f.withColumns({"outflow": out, "inflow": F.sum("value").over(Window.partitionBy("target")), "pct_of_outflow": percent(F.col("value"), out, 1)})


@query("gm13_mean_aggregation", "WITH f AS (SELECT l_suppkey AS node, CAST(count(*) AS DOUBLE) AS posts FROM {lineitem} GROUP BY 1) SELECT dst AS node, " + r.rnd("avg(posts)", 4) + " AS posts, count(*) AS n FROM (SELECT DISTINCT src, dst FROM {follows}) e JOIN f ON e.src = f.node GROUP BY 1")
def mean_aggregation(t: Tables) -> DataFrame:
    """One layer: each node's mean over those that point at it."""
    e = t.follows.select("src", "dst").distinct()
    f = t.lineitem.groupBy(F.col("l_suppkey").alias("node")).agg(F.count("*").cast("double").alias("posts"))
    n = e.join(f.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    return graph.mean_neighbours(e, f, ["posts"]).join(n, "node").select("node", round_to(F.col("posts"), 4).alias("posts"), "n")


@query("gm31_relational_mean", "WITH f AS (SELECT l_suppkey AS node, CAST(count(*) AS DOUBLE) AS posts FROM {lineitem} GROUP BY 1), e AS (SELECT DISTINCT 'follow' AS rel, src, dst FROM {follows} UNION ALL SELECT DISTINCT 'back', dst, src FROM {follows}), a AS (SELECT rel, dst AS node, avg(posts) AS m FROM e JOIN f ON e.src = f.node GROUP BY 1, 2) SELECT node, " + r.rnd("avg(m)", 4) + " AS mean, " + r.rnd("max(m)", 4) + " AS most, count(*) AS relations FROM a GROUP BY 1")
def relational_mean(t: Tables) -> DataFrame:
    """By relation first, then over the relations that a node has."""
    one = t.follows.select("src", "dst").distinct()
    e = one.withColumn("rel", F.lit("follow")).unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("back").alias("rel")))
    f = t.lineitem.groupBy(F.col("l_suppkey").alias("src")).agg(F.count("*").cast("double").alias("posts"))
    a = e.join(f, "src").groupBy("rel", F.col("dst").alias("node")).agg(F.avg("posts").alias("m"))
    return a.groupBy("node").agg(round_to(F.avg("m"), 4).alias("mean"), round_to(F.max("m"), 4).alias("most"), F.count("*").alias("relations"))


@query("gm25_nearest_centroid", "WITH s AS (SELECT cluster, i, avg(x) AS c FROM (SELECT cluster, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM {vectors}) GROUP BY 1, 2), n AS (SELECT cluster, sqrt(sum(c * c)) AS norm FROM s GROUP BY 1), v AS (SELECT node, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM {vectors}), d AS (SELECT node, s.cluster, sum(x * c) / max(norm) AS cos FROM v JOIN s USING (i) JOIN n ON s.cluster = n.cluster GROUP BY 1, 2) SELECT node, " + r.rnd("max(cos)", 6) + " AS cosine FROM d GROUP BY 1")
def nearest_centroid(t: Tables) -> DataFrame:
    """The largest cosine with any cluster's centroid. Centroids go to every task in blocks of BLOCK, and the largest of the blocks' cosines is kept."""
    parts = t.vectors.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    centroids = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda p: p["c"]).alias("c"))
    unit = centroids.select((F.transform("c", lambda x: x / F.sqrt(dot(F.col("c"), F.col("c"))))).alias("c"))
    numbered = graph.saved(unit.withColumn("block", F.floor(F.monotonically_increasing_id() / BLOCK)))
    every = numbered.groupBy("block").agg(F.collect_list("c").alias("all"))
    cos = F.array_max(F.transform("all", lambda c: dot(c, F.col("embedding"))))
    # A stated set (centroids, one for each cluster) against all rows, block by block.
    best = t.vectors.join(every.select("all")).groupBy("node").agg(F.max(cos).alias("cosine"))
    return best.select("node", round_to(F.col("cosine"), 6).alias("cosine"))


@query("gm21_candidate_ranking", f"{_CLUSTERS}, c AS (SELECT cluster, CASE WHEN {_ENRICH} <= 1 THEN {r.rnd('ln(1 + coalesce(intra, 0) / (1.0::DOUBLE * size))', 6)} ELSE 0 END AS novelty FROM g LEFT JOIN e USING (cluster), b), k AS (SELECT cluster, row_number() OVER (ORDER BY novelty DESC, cluster) AS cluster_rank FROM c) SELECT a.node, a.cluster, cluster_rank, row_number() OVER (PARTITION BY a.cluster ORDER BY score DESC, a.node) AS place FROM a JOIN k ON a.cluster = k.cluster JOIN (SELECT node, {_SCORE} AS score FROM {{vectors}}) s ON a.node = s.node WHERE NOT bad QUALIFY place <= 5")
def candidate_ranking(t: Tables) -> DataFrame:
    """Clusters by novelty (dense, yet no richer in known members than all), in each the best candidates by score."""
    known = cluster_all(t)
    novelty = F.when(F.col("enrich") <= 1, round_to(F.log1p(F.col("intra") / F.col("size")), 6)).otherwise(F.lit(0.0))
    ranks = known.select("cluster", novelty.alias("novelty")).withColumn("cluster_rank", F.row_number().over(Window.orderBy(F.desc("novelty"), "cluster")).cast("long")).drop("novelty")
    rows = assigned(t).where(~F.col("bad")).join(ranks, "cluster").join(linear_score(t), "node")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "node")).cast("long")
    return rows.withColumn("place", place).where("place <= 5").select("node", "cluster", "cluster_rank", "place")


def cluster_all(t: Tables) -> DataFrame:
    a = assigned(t)
    g = a.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(flag(F.col("bad"))).alias("bad")).join(intra_cluster_edges(t), "cluster", "left").withColumn("intra", F.coalesce("intra", F.lit(0)))
    base = a.agg((F.sum(flag(F.col("bad"))) / F.count("*")).alias("base"))
    return g.crossJoin(F.broadcast(base)).withColumn("enrich", (F.col("bad") / F.col("size")) / F.nullif(F.col("base"), F.lit(0.0)))


@query("gm27_stratified_negatives", f"SELECT node, bad FROM (SELECT node, bad, {_UNIFORM} AS u FROM {{node_labels}}) QUALIFY bad OR row_number() OVER (PARTITION BY bad ORDER BY u, node) <= 100")
def stratified_negatives(t: Tables) -> DataFrame:
    """All positives, and the first hundred negatives in the order of a hash."""
    neg = t.node_labels.where(~F.col("bad")).orderBy(uniform(F.col("node")), "node").limit(100)
    return t.node_labels.where("bad").unionByName(neg).select("node", "bad")


@query("wn01_latest_per_cluster", "SELECT cluster, max(node) AS node FROM {vectors} GROUP BY 1")
def latest_per_cluster(t: Tables) -> DataFrame:
    return latest_per_key(t.vectors.select("cluster", "node"), ["cluster"], [F.desc("node")])


@query("gm16_kmeans_clusters")
def kmeans_clusters(t: Tables) -> DataFrame:
    """Clusters found again from the vectors; not reproducible in SQL, so tests ask that they agree with the given ones."""
    from starlane.operators.learn import clusters

    return clusters(t.vectors, "embedding", 10).select("node", "cluster", "assigned")


@query("gm24_linear_probe")
def linear_probe(t: Tables) -> DataFrame:
    """A balanced logistic probe of the vectors, fitted on half of the labelled nodes (by a hash of the id) and scored on the other; tests ask that it tells them apart there."""
    from starlane.operators import learn

    rows = t.vectors.join(t.node_labels.select("node", F.col("bad").cast("int").alias("bad")), "node")
    seen = uniform(F.col("node"), 5) < 0.5
    return learn.linear_probe(rows.where(seen), rows.where(~seen), "embedding", "bad").select("node", "bad", round_to(F.col("probability"), 6).alias("probability"))
