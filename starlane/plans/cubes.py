"""Cubes by week and month, flows between hosts, and the summaries built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.functions.expr import bare, core_host, flag, month, percent, public_host, size_bucket, week
from starlane.operators.archetypes import hops, mask_users, merge, topn_else_other
from starlane.plans import registry as r
from starlane.plans.registry import query
from starlane.sources.bindings import Tables

CORE = "core.network"
TOP = 4
WATERMARK = "1998-01-01"


def collapsed(host: Column) -> Column:
    """All hosts of the platform under one name."""
    return F.when(core_host(host), F.lit(CORE)).otherwise(host)


def _collapsed(c: str) -> str:
    return f"CASE WHEN {c} LIKE '%.core.network' THEN '{CORE}' ELSE {c} END"


def cube(rows: DataFrame, keys: list[str], period: Column) -> DataFrame:
    return rows.groupBy(*keys, period.alias("period")).agg(F.count("*").alias("n"))


def _week(c: str) -> str:
    return f"CAST(date_trunc('week', {c}) AS DATE)"


def incremental(rows: DataFrame, keys: list[str], period: Column, cut: str) -> DataFrame:
    """What two runs leave behind: the cube up to a watermark, with the delta after it added by key."""
    at = F.lit(cut).cast("timestamp")
    return merge(cube(rows.where(F.col("ts") <= at), keys, period), cube(rows.where(F.col("ts") > at), keys, period), [*keys, "period"], {"n": "add"})


@query("q31_creation_weekly", f"SELECT host, {_week('ts')} AS period, count(*) AS n FROM {{creations}} GROUP BY 1, 2")
def creation_weekly(t: Tables) -> DataFrame:
    return incremental(t.creations, ["host"], week(F.col("ts")), WATERMARK)


@query("q31b_creation_monthly", "SELECT host, strftime(ts, '%Y-%m') AS period, count(*) AS n FROM {creations} GROUP BY 1, 2")
def creation_monthly(t: Tables) -> DataFrame:
    return incremental(t.creations, ["host"], month(F.col("ts")), WATERMARK)


@query("q32_migration_weekly", f"SELECT from_host, to_host, {_week('ts')} AS period, count(*) AS n FROM {{migrations}} GROUP BY 1, 2, 3")
def migration_weekly(t: Tables) -> DataFrame:
    return incremental(t.migrations, ["from_host", "to_host"], week(F.col("ts")), WATERMARK)


@query("q32b_migration_monthly", "SELECT from_host, to_host, strftime(ts, '%Y-%m') AS period, count(*) AS n FROM {migrations} GROUP BY 1, 2, 3")
def migration_monthly(t: Tables) -> DataFrame:
    return incremental(t.migrations, ["from_host", "to_host"], month(F.col("ts")), WATERMARK)


@query(
    "q33_stats",
    f"WITH c AS (SELECT count(*) AS total, {r.long_sum(chr(39).join(['host LIKE ', '%.core.network', '']))} AS core FROM {{current_host}}), m AS (SELECT count(DISTINCT did) AS movers FROM {{migrations}} WHERE from_host NOT LIKE '%.core.network') SELECT total AS total_accounts, {r.pct('core', 'total', 1)} AS core_pct, movers AS unique_movers FROM c, m",
)
def stats(t: Tables) -> DataFrame:
    """One row of totals."""
    c = t.current_host.agg(F.count("*").alias("total_accounts"), F.sum(flag(core_host(F.col("host")))).alias("core"))
    m = t.migrations.where(~core_host(F.col("from_host"))).agg(F.count_distinct("did").alias("unique_movers"))
    return c.crossJoin(F.broadcast(m)).select("total_accounts", percent(F.col("core"), F.col("total_accounts"), 1).alias("core_pct"), "unique_movers")


def outside(t: Tables) -> DataFrame:
    """Moves with the platform's hosts under one name, those inside the platform left out."""
    rows = t.migrations.withColumns({"from_host": collapsed(F.col("from_host")), "to_host": collapsed(F.col("to_host"))})
    return rows.where((F.col("from_host") != CORE) | (F.col("to_host") != CORE))


_MOVES = f"(SELECT did, op_id, ts, {_collapsed('from_host')} AS a, {_collapsed('to_host')} AS b FROM {{migrations}} WHERE NOT (from_host LIKE '%.core.network' AND to_host LIKE '%.core.network'))"


def labelled_edges(rows: DataFrame, source: str, target: str, top: int, tags: tuple[str, str]) -> DataFrame:
    named = topn_else_other(topn_else_other(rows.withColumn("__one", F.lit(1)), source, "__one", top), target, "__one", top)
    return named.groupBy(F.concat(source, F.lit(tags[0])).alias("source"), F.concat(target, F.lit(tags[1])).alias("target")).agg(F.count("*").alias("value"))


def journeys(t: Tables) -> DataFrame:
    """did, origin, current: first and last host of each account that moved, in one aggregation."""
    at = F.struct("ts", "op_id")
    return outside(t).groupBy("did").agg(F.min_by("from_host", at).alias("origin"), F.max_by("to_host", at).alias("current"))


_JOURNEYS = f"(SELECT did, arg_min(a, (ts, op_id)) AS origin, arg_max(b, (ts, op_id)) AS current FROM {_MOVES} GROUP BY did)"


@query(
    "q34_trajectory_edges",
    f"WITH j AS {_JOURNEYS}, o AS (SELECT origin FROM j GROUP BY 1 ORDER BY count(*) DESC, origin LIMIT {TOP - 1}), c AS (SELECT current FROM j GROUP BY 1 ORDER BY count(*) DESC, current LIMIT {TOP - 1}) SELECT CASE WHEN origin IN (SELECT origin FROM o) THEN origin ELSE 'Other' END || '@0' AS source, CASE WHEN current IN (SELECT current FROM c) THEN current ELSE 'Other' END || '@1' AS target, count(*) AS value FROM j GROUP BY 1, 2",
)
def trajectory_edges(t: Tables) -> DataFrame:
    return labelled_edges(journeys(t), "origin", "current", TOP - 1, ("@0", "@1"))


def dedup_journeys(t: Tables) -> DataFrame:
    """Compatible variant: equal moves of an account count once, at the first time, before the ends are taken."""
    first = outside(t).groupBy("did", "from_host", "to_host").agg(F.min(F.struct("ts", "op_id")).alias("at"))
    return first.groupBy("did").agg(F.min_by("from_host", "at").alias("origin"), F.max_by("to_host", "at").alias("current"))


@query(
    "q34b_trajectories_deduplicated",
    f"WITH d AS (SELECT did, a, b, min((ts, op_id)) AS at_ FROM {_MOVES} GROUP BY 1, 2, 3) SELECT did, arg_min(a, at_) AS origin, arg_max(b, at_) AS current FROM d GROUP BY 1",
)
def trajectories_deduplicated(t: Tables) -> DataFrame:
    return dedup_journeys(t)


#: Steps that are shown one by one, and the hosts that keep their name: the busiest, with so many ends of moves at least.
LAST, NAMED, LEAST_MOVES = 5, 15, 11


@query(
    "q35_migration_hops",
    f"""WITH s AS (SELECT did, a, b, row_number() OVER (PARTITION BY did ORDER BY ts, op_id) - 1 AS step FROM {_MOVES}),
    top AS (SELECT h FROM (SELECT a AS h FROM s UNION ALL SELECT b FROM s) GROUP BY 1 HAVING count(*) >= {LEAST_MOVES} ORDER BY count(*) DESC, h LIMIT {NAMED}),
    f AS (SELECT did, arg_max(b, step) AS final FROM s GROUP BY 1),
    l AS (SELECT CASE WHEN a IN (SELECT h FROM top) THEN a ELSE 'Other' END || '@' || step AS source, CASE WHEN b IN (SELECT h FROM top) THEN b ELSE 'Other' END || '@' || (step + 1) AS target FROM s WHERE step < {LAST}
          UNION ALL SELECT CASE WHEN a IN (SELECT h FROM top) THEN a ELSE 'Other' END || '@{LAST}', CASE WHEN final IN (SELECT h FROM top) THEN final ELSE 'Other' END || '@{LAST + 1}' FROM s JOIN f USING (did) WHERE step = {LAST})
    SELECT source, target, count(*) AS value FROM l GROUP BY 1, 2""",
)
def migration_hops(t: Tables) -> DataFrame:
    """Each account's moves by step; the last step shown goes to where the account ended."""
    steps = hops(outside(t), "did", ["ts", "op_id"])
    ends = Window.partitionBy("did")
    steps = steps.withColumn("final", F.max_by("to_host", "step").over(ends)).where(F.col("step") <= LAST)
    every = hops(outside(t), "did", ["ts", "op_id"]).select(F.explode(F.array("from_host", "to_host")).alias("host"))
    top = every.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_MOVES).orderBy(F.desc("n"), "host").limit(NAMED).select("host")
    name = lambda c: F.when(F.col(f"__{c}").isNotNull(), F.col(c)).otherwise(F.lit("Other"))
    rows = steps.withColumn("to", F.when(F.col("step") == LAST, F.col("final")).otherwise(F.col("to_host")))
    for c in ("from_host", "to"):
        rows = rows.join(F.broadcast(top.select(F.col("host").alias(f"__{c}"))), F.col(c) == F.col(f"__{c}"), "left")
    step = F.col("step").cast("string")
    return rows.groupBy(F.concat(name("from_host"), F.lit("@"), step).alias("source"), F.concat(name("to"), F.lit("@"), (F.col("step") + 1).cast("string")).alias("target")).agg(F.count("*").alias("value"))


@query("q36_lang_summary", "SELECT rtrim(host, '/') AS host, split_part(lang, '-', 1) AS lang, count(DISTINCT l.did) AS dids, CAST(sum(posts) AS BIGINT) AS posts FROM {did_langs} l JOIN {accounts} a ON l.did = a.did WHERE lang <> '' GROUP BY 1, 2 HAVING count(DISTINCT l.did) >= 2")
def lang_summary(t: Tables) -> DataFrame:
    rows = t.did_langs.where("lang <> ''").join(t.accounts, "did")
    return rows.groupBy(bare(F.col("host")).alias("host"), F.split_part("lang", F.lit("-"), F.lit(1)).alias("lang")).agg(F.count_distinct("did").alias("dids"), F.sum("posts").alias("posts")).where("dids >= 2")


@query("q37_active_creation_weekly", f"SELECT h.host, {_week('k.ts')} AS week, count(*) AS n FROM {{creations}} k JOIN {{current_host}} h ON k.did = h.did LEFT JOIN {{repo_status}} s ON k.did = s.did WHERE s.did IS NULL GROUP BY 1, 2")
def active_creation_weekly(t: Tables) -> DataFrame:
    """By the host that the account is on now, without accounts that are gone."""
    alive = t.creations.select("did", "ts").join(t.repo_status, "did", "left_anti").join(t.current_host, "did")
    return alive.groupBy("host", week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))


_BY_HOST = "count(DISTINCT a.did) AS active_users, " + ", ".join(f"count(DISTINCT CASE WHEN mask & {b} <> 0 THEN a.did END) AS {n}" for n, b in {"posters": 1, "likers": 2, "reposters": 4, "followers": 8}.items())


@query("q38_host_activity_summary", f"SELECT host, {_BY_HOST} FROM {{activity}} a JOIN {{accounts}} c ON a.did = c.did WHERE dt >= DATE '2024-01-30' - 14 GROUP BY 1")
def host_activity_summary(t: Tables) -> DataFrame:
    rows = t.activity.where(F.col("dt") >= F.date_sub(F.lit("2024-01-30").cast("date"), 14)).join(t.accounts, "did")
    return mask_users(rows, ["host"], "did", "mask", {"posters": 1, "likers": 2, "reposters": 4, "followers": 8}).withColumnRenamed("users", "active_users")


@query("q39_top_active_hosts", f"WITH h AS (SELECT host, {_BY_HOST} FROM {{activity}} a JOIN {{accounts}} c ON a.did = c.did WHERE dt >= DATE '2024-01-30' - 14 GROUP BY 1) SELECT * FROM h ORDER BY active_users DESC, host LIMIT 10")
def top_active_hosts(t: Tables) -> DataFrame:
    return host_activity_summary(t).orderBy(F.desc("active_users"), "host").limit(10)


_SUMMARY = f"(SELECT host, {_BY_HOST}, max(dt) AS updated_at FROM {{activity}} a JOIN {{accounts}} c ON a.did = c.did WHERE dt >= DATE '2024-01-30' - DAYS GROUP BY 1)"


def activity_summary(t: Tables, days: int) -> DataFrame:
    """Hosts' users of a window by what they did, and the last day that is in it."""
    rows = t.activity.where(F.col("dt") >= F.date_sub(F.lit("2024-01-30").cast("date"), days)).join(t.accounts, "did")
    merged = rows.groupBy("host", "did").agg(F.bit_or("mask").alias("m"), F.max("dt").alias("last"))
    users = lambda b: F.sum(flag(F.col("m").bitwiseAND(F.lit(b)) != 0))
    return merged.groupBy("host").agg(F.count("*").alias("active_users"), users(1).alias("posters"), users(2).alias("likers"), users(4).alias("reposters"), users(8).alias("followers"), F.max("last").alias("updated_at"))


@query("q67_host_activity", "SELECT * FROM (SELECT 30 AS days, * FROM A WHERE host NOT LIKE '%.core.network' ORDER BY active_users DESC, host LIMIT 15) UNION ALL SELECT * FROM (SELECT 7 AS days, * FROM B WHERE host NOT LIKE '%.core.network' ORDER BY active_users DESC, host LIMIT 15)".replace("A WHERE", _SUMMARY.replace("DAYS", "30") + " WHERE").replace("B WHERE", _SUMMARY.replace("DAYS", "7") + " WHERE"))
def host_activity(t: Tables) -> DataFrame:
    """The fifteen busiest hosts but for the platform's own, in two windows."""
    best = lambda days: activity_summary(t, days).where(~core_host(F.col("host"))).orderBy(F.desc("active_users"), "host").limit(15).select(F.lit(days).alias("days"), "*")
    return best(30).unionByName(best(7))


@query("q67b_activity_updated", "SELECT days, max(updated_at) AS updated_at FROM (SELECT 30 AS days, * FROM A UNION ALL SELECT 7, * FROM B) GROUP BY 1".replace("FROM A", "FROM " + _SUMMARY.replace("DAYS", "30")).replace("FROM B)", "FROM " + _SUMMARY.replace("DAYS", "7") + ")"))
def activity_updated(t: Tables) -> DataFrame:
    both = activity_summary(t, 30).withColumn("days", F.lit(30)).unionByName(activity_summary(t, 7).withColumn("days", F.lit(7)))
    return both.groupBy("days").agg(F.max("updated_at").alias("updated_at"))


@query("q40_changed_since", f"SELECT 'migrations' AS source, max(ts) > TIMESTAMP '{WATERMARK} 00:00:00' AS changed, {r.long_sum(chr(39).join(['ts > TIMESTAMP ', WATERMARK + ' 00:00:00', '']))} AS pending FROM {{migrations}}")
def changed_since(t: Tables) -> DataFrame:
    """Whether there is anything after the watermark; a rebuild is skipped if not."""
    at = F.lit(WATERMARK).cast("timestamp")
    return t.migrations.agg((F.max("ts") > at).alias("changed"), F.sum(flag(F.col("ts") > at)).alias("pending")).select(F.lit("migrations").alias("source"), "changed", "pending")


def series(rows: DataFrame, host: str, period: str, n: str, top: int = TOP) -> DataFrame:
    """Counts by period for the largest hosts, the rest as Other."""
    by = rows.groupBy(F.col(host).alias("host"), F.col(period).alias("period")).agg(F.sum(n).alias("n"))
    return topn_else_other(by, "host", "n", top).groupBy("period", "host").agg(F.sum("n").alias("n"))


def _series(inner: str, top: int = TOP) -> str:
    """inner gives host, period, n."""
    return f"WITH i AS ({inner}), c AS (SELECT host, period, sum(n) AS n FROM i GROUP BY 1, 2), top AS (SELECT host FROM c GROUP BY 1 ORDER BY sum(n) DESC, host LIMIT {top}) SELECT period, CASE WHEN host IN (SELECT host FROM top) THEN host ELSE 'Other' END AS host, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2"


@query("q41_creations_by_month", _series(f"SELECT {_collapsed('host')} AS host, strftime(ts, '%Y-%m') AS period, 1 AS n FROM {{creations}}", 2))
def creations_by_month(t: Tables) -> DataFrame:
    return series(cube(t.creations.withColumn("host", collapsed(F.col("host"))), ["host"], month(F.col("ts"))), "host", "period", "n", 2)


_VERIFIED = "(SELECT DISTINCT host FROM {current_host})"


def verified(t: Tables) -> DataFrame:
    return t.current_host.select("host").distinct()


@query("q42_creations_by_week", _series(f"SELECT {_collapsed('k.host')} AS host, {_week('ts')} AS period, 1 AS n FROM {{creations}} k LEFT JOIN {_VERIFIED} v ON k.host = v.host WHERE k.host <> 'https://4-none.host.net' AND (v.host IS NOT NULL OR k.host LIKE '%.core.network')", 2))
def creations_by_week(t: Tables) -> DataFrame:
    """Public hosts that a scan has seen (the platform's pass anyway), one host left out by name."""
    rows = t.creations.where(public_host(F.col("host")) & (F.col("host") != "https://4-none.host.net"))
    core, rest = core_host(F.col("host")), ~core_host(F.col("host"))
    rows = rows.where(core).unionByName(rows.where(rest).join(verified(t), "host", "left_semi").select(*rows.columns))
    return series(cube(rows.withColumn("host", collapsed(F.col("host"))), ["host"], week(F.col("ts"))), "host", "period", "n", 2)


@query("q42b_creations_by_week_indie", _series(f"SELECT host, {_week('ts')} AS period, 1 AS n FROM {{creations}} WHERE host NOT LIKE '%.core.network'", 2))
def creations_by_week_indie(t: Tables) -> DataFrame:
    rows = t.creations.where(public_host(F.col("host")) & ~core_host(F.col("host")))
    return series(cube(rows, ["host"], week(F.col("ts"))), "host", "period", "n", 2)


@query("q43_active_creations_by_week", _series(f"SELECT {_collapsed('h.host')} AS host, {_week('k.ts')} AS period, 1 AS n FROM {{creations}} k JOIN {{current_host}} h ON k.did = h.did LEFT JOIN {{repo_status}} s ON k.did = s.did WHERE s.did IS NULL", 2))
def active_creations_by_week(t: Tables) -> DataFrame:
    rows = active_creation_weekly(t).where(public_host(F.col("host"))).withColumn("host", collapsed(F.col("host")))
    return series(rows, "host", "week", "n", 2)


@query("q44_migrations_by_week", _series(f"SELECT to_host AS host, {_week('ts')} AS period, 1 AS n FROM {{migrations}} WHERE to_host NOT LIKE '%.core.network'", 2))
def migrations_by_week(t: Tables) -> DataFrame:
    return series(cube(t.migrations.where(~core_host(F.col("to_host"))), ["to_host"], week(F.col("ts"))), "to_host", "period", "n", 2)


@query("q44b_migrations_by_month", _series("SELECT to_host AS host, strftime(ts, '%Y-%m') AS period, 1 AS n FROM {migrations} WHERE to_host NOT LIKE '%.core.network'", 2))
def migrations_by_month(t: Tables) -> DataFrame:
    return series(cube(t.migrations.where(~core_host(F.col("to_host"))), ["to_host"], month(F.col("ts"))), "to_host", "period", "n", 2)


@query("q45_migration_flows", f"WITH j AS {_JOURNEYS} SELECT origin AS source, current AS target, count(*) AS value FROM j WHERE origin <> current GROUP BY 1, 2")
def migration_flows(t: Tables) -> DataFrame:
    """Edges without the step's suffix, taken off at the end of the name only; loops left out."""
    edges = labelled_edges(journeys(t), "origin", "current", 100, ("@0", "@1"))
    edges = edges.withColumns({"source": F.regexp_replace("source", "@0$", ""), "target": F.regexp_replace("target", "@1$", "")})
    return edges.where("source <> target")


@query(
    "q46_migration_weekly_breakdown",
    f"WITH m AS (SELECT {_collapsed('to_host')} AS h, ts FROM {{migrations}} WHERE NOT (from_host LIKE '%.core.network' AND to_host LIKE '%.core.network')), top AS (SELECT h FROM m GROUP BY 1 ORDER BY count(*) DESC, h LIMIT 3) SELECT {_week('ts')} AS week, CASE WHEN h = '{CORE}' OR h IN (SELECT h FROM top) THEN h ELSE 'Other destinations' END AS to_host, count(*) AS n FROM m WHERE {_week('ts')} >= DATE '2000-01-01' GROUP BY 1, 2",
)
def migration_weekly_breakdown(t: Tables) -> DataFrame:
    rows = outside(t)
    top = rows.groupBy("to_host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to_host").limit(3).select(F.col("to_host").alias("top"))
    weekly = rows.withColumn("week", week(F.col("ts"))).where(F.col("week") >= F.lit("2000-01-01").cast("date"))
    named = weekly.join(F.broadcast(top), F.col("to_host") == F.col("top"), "left")
    label = F.when((F.col("to_host") == CORE) | F.col("top").isNotNull(), F.col("to_host")).otherwise("Other destinations")
    return named.groupBy("week", label.alias("to_host")).agg(F.count("*").alias("n"))


@query(
    "q49_ecosystem_stats",
    f"WITH m AS (SELECT count(*) AS total_migrations, count(DISTINCT did) AS movers FROM {_MOVES}), c AS (SELECT strftime(min(ts), '%Y-%m') || '-01' AS earliest, strftime(max(ts), '%Y-%m') || '-01' AS latest, count(*) AS accounts FROM {{creations}}), h AS (SELECT count(DISTINCT host) AS hosts FROM {{current_host}} WHERE host NOT LIKE '%.core.network') SELECT accounts, total_migrations, movers, hosts AS indie_hosts, earliest, latest FROM m, c, h",
)
def ecosystem_stats(t: Tables) -> DataFrame:
    first = lambda f: F.concat(month(f("ts")), F.lit("-01"))
    m = outside(t).agg(F.count("*").alias("total_migrations"), F.count_distinct("did").alias("movers"))
    c = t.creations.agg(F.count("*").alias("accounts"), first(F.min).alias("earliest"), first(F.max).alias("latest"))
    h = t.current_host.where(~core_host(F.col("host"))).agg(F.count_distinct("host").alias("indie_hosts"))
    return m.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(h)).select("accounts", "total_migrations", "movers", "indie_hosts", "earliest", "latest")


@query("q50_migration_trajectories", "SELECT from_host AS source, to_host AS target, count(*) AS value FROM {migrations} GROUP BY 1, 2")
def migration_trajectories(t: Tables) -> DataFrame:
    return t.migrations.groupBy(F.col("from_host").alias("source"), F.col("to_host").alias("target")).agg(F.count("*").alias("value")).orderBy(F.desc("value"), "source", "target")


COHORTS = (("pre-1996", "1996-01-01"), ("1996", "1997-01-01"), ("1997 H1", "1997-07-01"), ("1997 H2", "1998-01-01"))


@query("q55_account_cohorts", f"WITH w AS (SELECT {_week('ts')} AS week FROM {{creations}}) SELECT CASE " + " ".join(f"WHEN week < DATE '{e}' THEN '{n}'" for n, e in COHORTS) + " ELSE 'later' END AS cohort, count(*) AS n, min(week) AS first_week FROM w GROUP BY 1")
def account_cohorts(t: Tables) -> DataFrame:
    w, label = week(F.col("ts")), F
    for name, end in COHORTS:
        label = label.when(F.col("week") < F.lit(end).cast("date"), name)
    return t.creations.select(w.alias("week")).groupBy(label.otherwise("later").alias("cohort")).agg(F.count("*").alias("n"), F.min("week").alias("first_week"))


@query("q56_top_langs", "WITH s AS (SELECT host, split_part(lang, '-', 1) AS lang, count(DISTINCT l.did) AS dids FROM {did_langs} l JOIN {accounts} a ON l.did = a.did WHERE host NOT LIKE '%.core.network' GROUP BY 1, 2 HAVING count(DISTINCT l.did) >= 2) SELECT lang, CAST(sum(dids) AS BIGINT) AS total_dids, count(DISTINCT host) AS hosts FROM s GROUP BY 1 ORDER BY total_dids DESC, lang LIMIT 25")
def top_langs(t: Tables) -> DataFrame:
    by = lang_summary(t).where(~core_host(F.col("host"))).groupBy("lang").agg(F.sum("dids").alias("total_dids"), F.count("host").alias("hosts"))
    return by.orderBy(F.desc("total_dids"), "lang").limit(25)


@query(
    "q57_journey_stats",
    f"""WITH p AS (SELECT did, count(*) AS n FROM {_MOVES} GROUP BY 1), c AS (SELECT n, count(*) AS users FROM p GROUP BY 1),
    k AS (SELECT n, users, sum(users) OVER (ORDER BY n) AS upto, sum(users) OVER () AS total FROM c)
    SELECT CAST(max(total) AS BIGINT) AS movers, max(n) AS most, min(CASE WHEN upto >= total / 2.0::DOUBLE THEN n END) AS median, {r.pct('sum(CASE WHEN n >= 2 THEN users ELSE 0 END)', 'max(total)')} AS pct_multiple,
    CAST(sum(CASE WHEN n = 1 THEN users ELSE 0 END) AS BIGINT) AS one, CAST(sum(CASE WHEN n BETWEEN 2 AND 4 THEN users ELSE 0 END) AS BIGINT) AS two_to_four, CAST(sum(CASE WHEN n BETWEEN 5 AND 9 THEN users ELSE 0 END) AS BIGINT) AS five_to_nine, CAST(sum(CASE WHEN n >= 10 THEN users ELSE 0 END) AS BIGINT) AS ten_or_more FROM k""",
)
def journey_stats(t: Tables) -> DataFrame:
    """Moves by account: the histogram of counts is small, and the median is read from its running sum."""
    counts = outside(t).groupBy("did").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("users"))
    k = counts.withColumns({"upto": F.sum("users").over(Window.orderBy("n")), "total": F.sum("users").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    users = lambda cond: F.sum(F.when(cond, F.col("users")).otherwise(0))
    n = F.col("n")
    return k.agg(
        F.max("total").alias("movers"), F.max("n").alias("most"), F.min(F.when(F.col("upto") >= F.col("total") / 2.0, n)).alias("median"), percent(users(n >= 2), F.max("total")).alias("pct_multiple"),
        users(n == 1).alias("one"), users(n.between(2, 4)).alias("two_to_four"), users(n.between(5, 9)).alias("five_to_nine"), users(n >= 10).alias("ten_or_more"),
    )


@query(
    "q66_collection_hosts",
    "SELECT split_part(collection, '.', 1) || '.' || split_part(collection, '.', 2) AS namespace, host, count(DISTINCT k.did) AS users, CAST(sum(n) AS BIGINT) AS records FROM {collections} k JOIN {accounts} a ON k.did = a.did GROUP BY 1, 2",
)
def collection_hosts(t: Tables) -> DataFrame:
    rows = t.collections.join(t.accounts, "did")
    return rows.groupBy(F.substring_index("collection", ".", 2).alias("namespace"), "host").agg(F.count_distinct("did").alias("users"), F.sum("n").alias("records"))


@query(
    "q70_lang_host_ranking",
    f"WITH s AS (SELECT host, split_part(lang, '-', 1) AS lang, count(DISTINCT l.did) AS dids FROM {{did_langs}} l JOIN {{accounts}} a ON l.did = a.did GROUP BY 1, 2 HAVING count(DISTINCT l.did) >= 2), p AS (SELECT *, {r.pct('dids', 'sum(dids) OVER (PARTITION BY host)', 1)} AS pct_of_host FROM s) SELECT lang, host, dids, pct_of_host, row_number() OVER (PARTITION BY lang ORDER BY dids DESC, pct_of_host DESC, host) AS rank FROM p QUALIFY rank <= 5",
)
def lang_host_ranking(t: Tables) -> DataFrame:
    """The five hosts with most speakers of each language, and the language's share of each host."""
    share = lang_summary(t).withColumn("pct_of_host", percent(F.col("dids"), F.sum("dids").over(Window.partitionBy("host")), 1))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("dids"), F.desc("pct_of_host"), "host"))
    return share.withColumn("rank", rank.cast("long")).where("rank <= 5").select("lang", "host", "dids", "pct_of_host", "rank")


@query(
    "q70b_namespace_ranking",
    "WITH g AS (SELECT split_part(collection, '.', 1) || '.' || split_part(collection, '.', 2) AS namespace, count(DISTINCT did) AS users, CAST(sum(n) AS BIGINT) AS records FROM {collections} GROUP BY 1) SELECT *, CASE WHEN users <= 1 THEN '1' WHEN users <= 5 THEN '2-5' WHEN users <= 10 THEN '6-10' WHEN users <= 50 THEN '11-50' WHEN users <= 100 THEN '51-100' ELSE '101+' END AS size_class FROM g ORDER BY users DESC, namespace LIMIT 12",
)
def namespace_ranking(t: Tables) -> DataFrame:
    by = t.collections.groupBy(F.substring_index("collection", ".", 2).alias("namespace")).agg(F.count_distinct("did").alias("users"), F.sum("n").alias("records"))
    label = F.when(F.col("users") <= 100, size_bucket(F.col("users"))).otherwise("101+")
    return by.withColumn("size_class", label).orderBy(F.desc("users"), "namespace").limit(12)
