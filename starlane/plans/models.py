"""Features and models of the ranking side: the tabular columns, three feature modes, hard negatives, boosted trees and a held-out probe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.functions.expr import flag, round_to, uniform
from starlane.operators import graph, learn
from starlane.plans import registry as r
from starlane.plans.graphs import CUTOFF, node_ids
from starlane.plans.registry import query
from starlane.sources.bindings import Tables
from starlane.sources.scratch import shared_folder

BINS, NEGATIVES, HARD = 24, 3, 0.5

# What is known of each node, as counts.
_KNOWN = """SELECT l_partkey AS node, count(*) AS posts, count(DISTINCT l_suppkey) AS follows, count(DISTINCT l_orderkey) AS followers, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS likes_out,
    CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS likes_in, CAST(sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS blocks_in, CAST(sum(CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END) AS BIGINT) AS blocks_out,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS reposts_out, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS replies_out, CAST(sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS quotes_out,
    CAST(sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS post_deletes, count(DISTINCT CAST(l_shipdate AS DATE)) AS active_days, CAST(max(CAST(l_shipdate AS DATE)) - DATE '1995-01-01' AS BIGINT) AS last_day, CAST(min(CAST(l_shipdate AS DATE)) - DATE '1995-01-01' AS BIGINT) AS first_day FROM {lineitem} GROUP BY 1"""


#: What is counted of a node's lines, a bit each.
_COUNTED = {
    "likes_out": "l_returnflag = 'A'", "likes_in": "l_returnflag = 'N'", "blocks_in": "l_quantity > 45", "blocks_out": "l_quantity < 3", "reposts_out": "l_linestatus = 'O'",
    "replies_out": "l_returnflag = 'R'", "quotes_out": "l_linenumber = 1", "post_deletes": "l_discount > 0.08D",
}


def known(t: Tables, of: DataFrame | None = None) -> DataFrame:
    """A row for each node, the null one too, or for each with lines that `of` names. Others' lines go before anything is moved. Lines go to their node once, as keys, a day and bits; the first of equal values is found there by sorting, so no line is copied for a distinct count."""
    since = lambda d: F.datediff(d, F.lit("1995-01-01").cast("date")).cast("long")
    marks = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(flag(F.expr(c)), i) for i, c in enumerate(_COUNTED.values())))
    lines = t.lineitem.select(F.col("l_partkey").alias("node"), "l_suppkey", "l_orderkey", F.to_date("l_shipdate").alias("day"), marks.alias("marks"))
    lines = (lines if of is None else lines.join(of.select("node"), "node", "left_semi")).repartition("node")
    distinct = {"follows": "l_suppkey", "followers": "l_orderkey", "active_days": "day"}
    for name, c in distinct.items():
        lines = lines.withColumn(name, flag(F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy("node", c).orderBy(c)) == 1)))
    return lines.groupBy("node").agg(
        F.count("*").alias("posts"), *(F.sum(c).alias(c) for c in distinct), *(F.sum(F.getbit("marks", F.lit(i)).cast("long")).alias(c) for i, c in enumerate(_COUNTED)), since(F.max("day")).alias("last_day"), since(F.min("day")).alias("first_day")
    )


#: name: (what it is made of, how it ends: log, as it is, or clipped at a value). Text that Spark and other engines read alike.
FEATURES = {
    "log_followers": ("followers", "log"), "log_follows": ("follows", "log"), "log_posts": ("posts", "log"), "log_likes_out": ("likes_out", "log"), "log_likes_in": ("likes_in", "log"), "log_blocks_in": ("blocks_in", "log"),
    "log_blocks_out": ("blocks_out", "log"), "log_reposts_out": ("reposts_out", "log"), "log_replies_out": ("replies_out", "log"), "log_quotes_out": ("quotes_out", "log"),
    "follow_ratio": ("follows / nullif(CAST(followers AS DOUBLE), 0)", "log"), "blocks_in_ratio": ("blocks_in / nullif(CAST(followers AS DOUBLE), 0)", "log"), "reply_ratio": ("replies_out / nullif(CAST(posts AS DOUBLE), 0)", 50),
    "repost_ratio": ("reposts_out / nullif(CAST(posts + reposts_out AS DOUBLE), 0)", None), "like_per_post": ("likes_out / nullif(CAST(posts AS DOUBLE), 0)", "log"), "likes_in_per_post": ("likes_in / nullif(CAST(posts AS DOUBLE), 0)", "log"),
    "account_age_days": ("2500 - first_day", None), "is_core_host": ("CASE WHEN node % 10 = 0 THEN 1 ELSE 0 END", None), "log_creation_burst": ("first_day % 30", "log"), "active_days": ("active_days", None), "recency_days": ("2500 - last_day", 9999),
    "follows_per_active_day": ("follows / nullif(CAST(active_days AS DOUBLE), 0)", "log"), "log_post_deletes": ("post_deletes", "log"), "delete_rate": ("post_deletes / nullif(CAST(posts AS DOUBLE), 0)", 50),
}


def _feature(text: str, end: str | int | None) -> str:
    """What is undefined is 0."""
    x = f"CAST({text} AS DOUBLE)"
    x = f"ln(1 + {x})" if end == "log" else f"least(greatest({x}, 0), {end})" if end else x
    return f"coalesce({x}, 0)"


def features(t: Tables, of: DataFrame | None = None) -> DataFrame:
    return known(t, of).select("node", *(F.expr(_feature(*how)).cast("double").alias(name) for name, how in FEATURES.items()))


@query("gm08b_all_features", f"WITH k AS ({_KNOWN}) SELECT node, " + ", ".join(f"{r.rnd(_feature(*how), 6)} AS {name}" for name, how in FEATURES.items()) + " FROM k")
def all_features(t: Tables) -> DataFrame:
    """The 24 columns: logs, ratios, clipped; what is undefined is 0."""
    return features(t).select("node", *(round_to(F.col(c), 6).alias(c) for c in FEATURES))


_RATIOS = {"follow_ratio": ("follows", "followers"), "blocks_in_ratio": ("blocks_in", "followers"), "reply_ratio": ("replies_out", "posts"), "repost_ratio": ("reposts_out", "posts + reposts_out"), "like_per_post": ("likes_out", "posts"), "likes_in_per_post": ("likes_in", "posts")}
_MODES = {"degree_out": "ln(1 + CAST(follows AS DOUBLE))", "degree_in": "ln(1 + CAST(followers AS DOUBLE))", **{k: f"ln(1 + CAST({a} AS DOUBLE) / (CAST({b} AS DOUBLE) + 1))" for k, (a, b) in _RATIOS.items()}}


def modes(t: Tables, mode: str) -> DataFrame:
    """degree: two columns; stable: these and six ratios, scaled by mean and sample deviation; full: all 24."""
    if mode == "full":
        return features(t)
    if mode == "degree":
        return known(t).select("node", *(F.expr(_MODES[k]).alias(k) for k in ("degree_out", "degree_in")))
    # Read twice, so the lines are counted once.
    rows = graph.saved(known(t).select("node", *(F.expr(x).alias(k) for k, x in _MODES.items())))
    s = rows.agg(*(f(k).alias(f"{k}_{n}") for k in _MODES for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    return rows.crossJoin(F.broadcast(s)).select("node", *(((F.col(k) - F.col(f"{k}_m")) / (F.coalesce(f"{k}_s", F.lit(0.0)) + 1e-8)).alias(k) for k in _MODES))


@query("gm07b_stable_features", f"WITH k AS ({_KNOWN}), x AS (SELECT node, " + ", ".join(f"{x} AS {k}" for k, x in _MODES.items()) + " FROM k), s AS (SELECT " + ", ".join(f"avg({k}) AS {k}_m, stddev_samp({k}) AS {k}_s" for k in _MODES) + " FROM x) SELECT node, " + ", ".join(f"{r.rnd(f'({k} - {k}_m) / ({k}_s + 1e-8::DOUBLE)', 4)} AS {k}" for k in _MODES) + " FROM x, s")
def stable_features(t: Tables) -> DataFrame:
    return modes(t, "stable").select("node", *(round_to(F.col(k), 4).alias(k) for k in _MODES))


@query("gm07c_degree_features", f"WITH k AS ({_KNOWN}) SELECT node, {r.rnd(_MODES['degree_out'], 6)} AS degree_out, {r.rnd(_MODES['degree_in'], 6)} AS degree_in FROM k")
def degree_features(t: Tables) -> DataFrame:
    return modes(t, "degree").select("node", round_to(F.col("degree_out"), 6).alias("degree_out"), round_to(F.col("degree_in"), 6).alias("degree_in"))


_LABELLED = f"(SELECT k.node, bad AS hit, first_labeled >= DATE '{CUTOFF}' AS late, ln(1 + CAST(follows AS DOUBLE)) AS lo, ln(1 + CAST(followers AS DOUBLE)) AS li FROM k JOIN {{node_labels}} l ON k.node = l.node)"
_U = "(('0x' || substr(md5('SEED:' || node), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967297.0::DOUBLE"
_BIN = f"CAST(least(floor((X - min(X) OVER ()) / (max(X) OVER () - min(X) OVER () + 1e-9::DOUBLE) * {BINS}), {BINS - 1}) AS BIGINT)"


def labelled(t: Tables) -> DataFrame:
    rows = known(t, t.node_labels).join(t.node_labels, "node")
    return rows.withColumns({"late": F.col("first_labeled") >= F.lit(CUTOFF).cast("date"), "lo": F.log1p("follows"), "li": F.log1p("followers")})


def hard_negatives(rows: DataFrame, ratio: int = NEGATIVES, hard: float = HARD, bins: int = BINS) -> DataFrame:
    """All positives, and ratio negatives for each: a share of them likelier where positives are, by a histogram of both degrees, the others by chance.

    rows: node, hit, lo, li. Sampling without replacement is by the largest of log weight plus Gumbel noise from a hash of the id.
    """
    edges = rows.agg(*(f(c).alias(f"{c}_{n}") for c in ("lo", "li") for n, f in (("min", F.min), ("max", F.max))), F.sum(flag(F.col("hit"))).alias("n_pos"), F.sum(flag(~F.col("hit"))).alias("n_neg"))
    bin_ = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}_min")) / (F.col(f"{c}_max") - F.col(f"{c}_min") + 1e-9) * bins), F.lit(bins - 1))
    binned = rows.crossJoin(F.broadcast(edges)).select("node", "hit", bin_("lo").alias("bo"), bin_("li").alias("bi"), "n_pos", "n_neg")
    # At most bins * bins rows.
    density = binned.where("hit").groupBy("bo", "bi").agg((F.count("*") / F.first("n_pos")).alias("w"))
    neg = binned.where(~F.col("hit")).join(F.broadcast(density), ["bo", "bi"], "left")
    sizes = edges.first()
    take = min(sizes.n_neg or 0, ratio * (sizes.n_pos or 0))
    n_hard = int(take * hard)
    p = (uniform(F.col("node")) * float(1 << 32) + 0.5) / 4294967297.0
    chosen = neg.orderBy((F.log(F.coalesce("w", F.lit(0.0)) + 1e-6) - F.log(-F.log(p))).desc(), "node").limit(n_hard).select("node", F.lit("hard").alias("kind"))
    easy = neg.join(chosen.select("node"), "node", "left_anti").orderBy(uniform(F.col("node"), 7), "node").limit(take - n_hard).select("node", F.lit("easy").alias("kind"))
    return rows.where("hit").select("node", F.lit("positive").alias("kind")).unionByName(chosen).unionByName(easy)


@query(
    "gm12_hard_negatives",
    f"""WITH k AS ({_KNOWN}), x AS {_LABELLED}, b AS (SELECT node, hit, {_BIN.replace('X', 'lo')} AS bo, {_BIN.replace('X', 'li')} AS bi FROM x), c AS (SELECT {r.long_sum('hit')} AS p, {r.long_sum('NOT hit')} AS n FROM x),
    m AS (SELECT least(n, {NEGATIVES} * p) AS take, CAST(floor(least(n, {NEGATIVES} * p) * {HARD}::DOUBLE) AS BIGINT) AS n_hard, p FROM c), d AS (SELECT bo, bi, 1.0::DOUBLE * count(*) / (SELECT p FROM c) AS w FROM b WHERE hit GROUP BY 1, 2),
    h AS (SELECT node, row_number() OVER (ORDER BY ln(coalesce(w, 0.0::DOUBLE) + 1e-6::DOUBLE) - ln(-ln({_U.replace('SEED', '42')})) DESC, node) AS k FROM b LEFT JOIN d ON b.bo = d.bo AND b.bi = d.bi WHERE NOT hit),
    e AS (SELECT node, row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || node), 1, 8))::BIGINT, node) AS k FROM h, m WHERE h.k > n_hard)
    SELECT node, 'positive' AS kind FROM b WHERE hit UNION ALL SELECT node, 'hard' FROM h, m WHERE k <= n_hard UNION ALL SELECT node, 'easy' FROM e, m WHERE k <= take - n_hard""",
)
def hard_negative_sample(t: Tables) -> DataFrame:
    return hard_negatives(labelled(t).select("node", F.col("bad").alias("hit"), "lo", "li"))


@query("gm26_boosted_trees")
def boosted_trees(t: Tables) -> DataFrame:
    """Boosted trees over the 24 columns, split by date and by chance: fitted on what either split knows, with scores of the rest. Not reproducible in SQL."""
    late = (F.col("first_labeled") >= F.lit(CUTOFF).cast("date")).alias("late")
    rows = graph.saved(features(t, t.node_labels).join(t.node_labels.select("node", F.col("bad").cast("int").alias("bad"), late), "node"))
    u = uniform(F.col("node"))
    # Positives by date, negatives by chance in both splits.
    splits = {"temporal": F.when(F.col("bad") == 1, F.col("late")).otherwise(u >= 0.7), "random": u >= 0.7}
    out = None
    for name, test in splits.items():
        split = graph.saved(rows.withColumn("test", F.coalesce(test, F.lit(False))))
        part = learn.boosted_trees(split.where("NOT test"), split.where("test"), list(FEATURES), "bad").select(F.lit(name).alias("split"), "node", "bad", round_to(F.col("probability"), 6).alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


@query("snk21b_saved_models", "SELECT model, count(*) AS nodes, count(*) AS agreeing FROM (SELECT 'probe' AS model FROM {vectors} v JOIN {node_labels} l ON v.node = l.node UNION ALL SELECT 'trees' FROM (SELECT DISTINCT l_partkey AS node FROM {lineitem}) f JOIN {node_labels} l ON f.node = l.node) GROUP BY 1")
def saved_models(t: Tables) -> DataFrame:
    """A probe and boosted trees as artefacts: fitted, saved, loaded again; nodes whose scores are the same before and after."""
    path, bad = shared_folder(t.spark), F.col("bad").cast("int").alias("bad")
    labels = t.node_labels.select("node", bad)
    probe, trees = graph.saved(t.vectors.join(labels, "node")), graph.saved(features(t, labels).join(labels, "node"))
    models = {
        "probe": (learn.fitted_probe(probe, "embedding", "bad"), probe, lambda m, rows: learn.scored(m, learn.vectors(rows, "embedding"))),
        "trees": (learn.fitted_trees(trees, list(FEATURES), "bad", rounds=5), trees, learn.scored),
    }
    out = None
    for name, (model, rows, score) in models.items():
        learn.save_model(model, f"{path}/{name}")
        # Both scores stand in one row, so rows are neither moved nor matched, and repeated nodes count as often as they are there.
        both = score(learn.load_model(f"{path}/{name}"), score(model, rows).withColumnRenamed("probability", "before"))
        same = both.groupBy(F.lit(name).alias("model")).agg(F.count("*").alias("nodes"), F.sum(flag(F.col("before") == F.col("probability"))).alias("agreeing"))
        out = same if out is None else out.unionByName(same)
    return out


@query("gm06_core_ids", "WITH RECURSIVE n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM {follows} UNION SELECT dst FROM {follows})), d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {follows} UNION ALL SELECT dst FROM {follows}) GROUP BY 1 HAVING count(*) >= 4) SELECT n.node, n.idx, row_number() OVER (ORDER BY n.node) - 1 AS local FROM n JOIN d ON n.node = d.node".replace("WITH RECURSIVE", "WITH"))
def core_ids(t: Tables) -> DataFrame:
    """What is left after a filter by degree, with ids of its own beside those of the whole graph."""
    left = graph.degrees(t.follows).where("degree >= 4").select("node")
    return node_ids(t).join(graph.node_ids(left, "node").withColumnRenamed("idx", "local"), "node")
