"""Activity, engagement and retention by account-age cohort. Every query is as of a given day, over a window of days before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.functions.expr import AGE_BUCKETS, BITS, FOLLOW, LAST_BUCKET, LIKE, NEW_BUCKET, NEW_DAYS, POST, age_bucket, flag, has, month, namespace, percent, round_to, spread, week, week_before
from starlane.operators.archetypes import anti_exclude, day_gap, day_n_retention, mask_users, topn_else_other, trailing_distinct, with_total, within_n_days, zero_fill
from starlane.plans import registry as r
from starlane.plans.registry import query
from starlane.sources.bindings import Tables

AS_OF, DAYS, LOOKBACK = "2024-01-30", 30, 90
TREND, MAU = 20, 28


def day(text: str = AS_OF) -> Column:
    return F.lit(text).cast("date")


def bucket(as_of: str = AS_OF) -> Column:
    return age_bucket(F.col("created"), day(as_of)).alias("age_bucket")


_BUCKET = f"CASE WHEN created >= DATE '{AS_OF}' - {NEW_DAYS} THEN '{NEW_BUCKET}' " + " ".join(f"WHEN created < DATE '{end}' THEN '{label}'" for label, end in AGE_BUCKETS) + f" ELSE '{LAST_BUCKET}' END"
_SINCE = f"dt >= DATE '{AS_OF}' - {DAYS}"
_CLEAN = f"(SELECT DISTINCT a.did, a.mask FROM {{activity}} a LEFT JOIN {{excluded}} x ON a.did = x.did WHERE x.did IS NULL AND {_SINCE})"
_DAILY = f"(SELECT a.did, a.dt, a.mask FROM {{activity}} a LEFT JOIN {{excluded}} x ON a.did = x.did WHERE x.did IS NULL AND {_SINCE})"
_ALL_DAILY = f"(SELECT a.did, a.dt, a.mask FROM {{activity}} a LEFT JOIN {{excluded}} x ON a.did = x.did WHERE x.did IS NULL AND dt >= DATE '{AS_OF}' - {LOOKBACK})"
_MASKS = ", ".join(f"{r.long_sum(f'mask & {b} <> 0')} AS {n}" for n, b in BITS.items())


def window(t: Tables, days: int = DAYS) -> DataFrame:
    """did, dt, mask of the last days, without excluded accounts."""
    return anti_exclude(t.activity.where(F.col("dt") >= F.date_sub(day(), days)), t.excluded, "did")


def masks(t: Tables) -> DataFrame:
    """Distinct (did, mask) of the window, which is what `total` counts."""
    return window(t).select("did", "mask").distinct()


def cohort(t: Tables) -> DataFrame:
    return t.cohort.select("did", "created", "host", "host_type", bucket())


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), *(F.coalesce(F.sum(flag(has(F.col("mask"), b))), F.lit(0)).alias(n) for n, b in BITS.items())]


@query("q00_active_window", f"SELECT did, mask FROM {_CLEAN}")
def active_window(t: Tables) -> DataFrame:
    return masks(t)


@query("q00b_core_cohort", "SELECT c.did, c.created, c.host FROM {cohort} c LEFT JOIN {creations} k ON c.did = k.did WHERE c.host LIKE '%.core.network' OR k.host LIKE '%.core.network'")
def core_cohort(t: Tables) -> DataFrame:
    """Accounts on a core host now, and those elsewhere that were created on one."""
    now = t.cohort.where("host_type = 'core'")
    came = t.cohort.where("host_type <> 'core'").join(t.creations.where(F.col("host").endswith(".core.network")).select("did"), "did", "left_semi")
    return now.unionByName(came).select("did", "created", "host")


@query(
    "q01_activity_by_age",
    f"WITH b AS (SELECT {_BUCKET} AS age_bucket, mask FROM {_CLEAN} a JOIN {{cohort}} c ON a.did = c.did) SELECT age_bucket, count(*) AS total, {_MASKS} FROM b GROUP BY 1 UNION ALL SELECT '~ TOTAL', count(*), {_MASKS} FROM b",
)
def activity_by_age(t: Tables) -> DataFrame:
    return with_total(masks(t).join(cohort(t), "did"), ["age_bucket"], _counts(), {"age_bucket": "~ TOTAL"})


@query(
    "q02_activity_by_label",
    f"WITH b AS (SELECT label, mask FROM (SELECT DISTINCT did, mask FROM {{activity}} WHERE {_SINCE}) a JOIN {{account_labels}} l ON a.did = l.did) SELECT label, count(*) AS total, {_MASKS} FROM b GROUP BY 1 UNION ALL SELECT '~ TOTAL', count(*), {_MASKS} FROM b",
)
def activity_by_label(t: Tables) -> DataFrame:
    active = t.activity.where(F.col("dt") >= F.date_sub(day(), DAYS)).select("did", "mask").distinct()
    return with_total(active.join(t.account_labels, "did"), ["label"], _counts(), {"label": "~ TOTAL"})


_STICK = f"{r.rnd('avg(n)', 0)} AS avg_daily, {r.rnd(r.spread('n'), 1)} AS stddev_daily, {{u}} AS total_uniques, {r.rnd('avg(n) / {u}', 3)} AS ratio"


def _stick() -> list[Column]:
    n, u = F.col("n"), F.col("total_uniques")
    return [round_to(F.avg(n), 0).alias("avg_daily"), round_to(spread(n), 1).alias("stddev_daily"), F.max(u).alias("total_uniques"), round_to(F.avg(n) / F.max(u), 3).alias("ratio")]


@query("q03_stickiness", f"WITH d AS (SELECT dt, count(DISTINCT did) AS n FROM {_DAILY} GROUP BY dt), u AS (SELECT count(DISTINCT did) AS u FROM {_DAILY}) SELECT {_STICK.replace('{u}', 'max(u)')} FROM d, u")
def stickiness(t: Tables) -> DataFrame:
    w = window(t)
    # One row: bounded.
    return w.groupBy("dt").agg(F.count("*").alias("n")).crossJoin(F.broadcast(w.agg(F.count_distinct("did").alias("total_uniques")))).agg(*_stick())


@query(
    "q04_stickiness_by_age",
    f"WITH b AS (SELECT a.did, dt, {_BUCKET} AS age_bucket FROM {_DAILY} a JOIN {{cohort}} c ON a.did = c.did), d AS (SELECT dt, age_bucket, count(DISTINCT did) AS n FROM b GROUP BY 1, 2), u AS (SELECT age_bucket, count(DISTINCT did) AS u FROM b GROUP BY 1) SELECT age_bucket, {_STICK.replace('{u}', 'max(u)')} FROM d JOIN u USING (age_bucket) GROUP BY age_bucket",
)
def stickiness_by_age(t: Tables) -> DataFrame:
    b = window(t).join(cohort(t), "did")
    return b.groupBy("dt", "age_bucket").agg(F.count_distinct("did").alias("n")).join(b.groupBy("age_bucket").agg(F.count_distinct("did").alias("total_uniques")), "age_bucket").groupBy("age_bucket").agg(*_stick())


def _ranges(x: str, ranges: dict[str, tuple[int, int | None]]) -> list[Column]:
    return [F.coalesce(F.sum(flag((F.col(x) >= lo) & (F.col(x) <= hi) if hi is not None else F.col(x) >= lo)), F.lit(0)).alias(n) for n, (lo, hi) in ranges.items()]


def _ranges_sql(x: str, ranges: dict[str, tuple[int, int | None]]) -> str:
    return ", ".join(r.long_sum(f"{x} >= {lo}" + (f" AND {x} <= {hi}" if hi is not None else "")) + f" AS {n}" for n, (lo, hi) in ranges.items())


ACTIVE_DAYS = {"days_1": (1, 1), "days_2": (2, 2), "days_3_5": (3, 5), "days_6_14": (6, 14), "days_15plus": (15, None)}


@query(
    "q05_active_days_dist",
    f"WITH u AS (SELECT a.did, {_BUCKET} AS age_bucket, count(DISTINCT dt) AS n FROM {_DAILY} a JOIN {{cohort}} c ON a.did = c.did GROUP BY 1, 2) SELECT age_bucket, count(*) AS users, {r.rnd('avg(n)', 2)} AS avg_active_days, {r.rnd(r.spread('n'), 2)} AS stddev_active_days, {_ranges_sql('n', ACTIVE_DAYS)} FROM u GROUP BY 1",
)
def active_days_dist(t: Tables) -> DataFrame:
    users = window(t).groupBy("did").agg(F.count("*").alias("n")).join(cohort(t), "did")
    return users.groupBy("age_bucket").agg(F.count("*").alias("users"), round_to(F.avg("n"), 2).alias("avg_active_days"), round_to(spread(F.col("n")), 2).alias("stddev_active_days"), *_ranges("n", ACTIVE_DAYS))


@query(
    "q06_cohort_activation",
    f"WITH s AS (SELECT {_BUCKET} AS age_bucket, count(*) AS total_repos FROM {{cohort}} GROUP BY 1), a AS (SELECT {_BUCKET} AS age_bucket, count(DISTINCT a.did) AS n FROM {_CLEAN} a JOIN {{cohort}} c ON a.did = c.did GROUP BY 1) SELECT age_bucket, total_repos, coalesce(n, 0) AS active_users, {r.pct('coalesce(n, 0)', 'total_repos')} AS pct_active FROM s LEFT JOIN a USING (age_bucket)",
)
def cohort_activation(t: Tables) -> DataFrame:
    c = cohort(t)
    active = window(t).select("did").distinct().join(c, "did").groupBy("age_bucket").agg(F.count("*").alias("active_users"))
    return zero_fill(active, c.groupBy("age_bucket").agg(F.count("*").alias("total_repos")), ["age_bucket"], ["active_users"]).withColumn("pct_active", percent(F.col("active_users"), F.col("total_repos")))


@query(
    "q07_action_rates",
    f"WITH s AS (SELECT {_BUCKET} AS age_bucket, count(*) AS cohort_size FROM {{cohort}} GROUP BY 1), u AS (SELECT did, bit_or(mask) AS mask FROM {_DAILY} GROUP BY 1), a AS (SELECT {_BUCKET} AS age_bucket, {_MASKS} FROM u JOIN {{cohort}} c ON u.did = c.did GROUP BY 1) SELECT age_bucket, cohort_size, "
    + ", ".join(f"coalesce({n}, 0) AS {n}_n, {r.pct(f'coalesce({n}, 0)', 'cohort_size')} AS pct_{n}" for n in BITS)
    + " FROM s LEFT JOIN a USING (age_bucket)",
)
def action_rates(t: Tables) -> DataFrame:
    c = cohort(t)
    did = mask_users(window(t).join(c, "did"), ["age_bucket"], "did", "mask", {f"{n}_n": b for n, b in BITS.items()}).drop("users")
    out = zero_fill(did, c.groupBy("age_bucket").agg(F.count("*").alias("cohort_size")), ["age_bucket"], [f"{n}_n" for n in BITS])
    return out.withColumns({f"pct_{n}": percent(F.col(f"{n}_n"), F.col("cohort_size")) for n in BITS})


_GONE = {"deactivated": "status = 'deactivated'", "takendown": "status = 'takendown'", "total_non_active": "status IS NOT NULL"}


@query(
    "q08_non_active",
    f"WITH b AS (SELECT {_BUCKET} AS age_bucket, status FROM {{accounts}} a LEFT JOIN {{repo_status}} s ON a.did = s.did), g AS (SELECT age_bucket, {r.long_sum('status IS NULL')} AS cohort_size, "
    + ", ".join(f"{r.long_sum(c)} AS {n}_n" for n, c in _GONE.items())
    + " FROM b GROUP BY 1) SELECT age_bucket, cohort_size, "
    + ", ".join(f"{n}_n, {r.pct(f'{n}_n', 'cohort_size')} AS pct_{n}" for n in _GONE)
    + " FROM g WHERE cohort_size > 0",
)
def non_active(t: Tables) -> DataFrame:
    """Accounts that are gone against those that are not, in one pass over accounts and statuses."""
    b = t.accounts.join(t.repo_status, "did", "left").select(bucket(), "status")
    out = b.groupBy("age_bucket").agg(F.sum(flag(F.col("status").isNull())).alias("cohort_size"), *(F.sum(flag(F.expr(c))).alias(f"{n}_n") for n, c in _GONE.items())).where("cohort_size > 0")
    return out.withColumns({f"pct_{n}": percent(F.col(f"{n}_n"), F.col("cohort_size")) for n in _GONE})


_EVENTS = ("deleted", "deactivated", "reactivated", "takendown")


@query("q09_account_events", f"SELECT dt, {', '.join(f'''CAST(sum(CASE WHEN event_type = 'account:{e}' THEN n ELSE 0 END) AS BIGINT) AS {e}''' for e in _EVENTS)} FROM {{account_events}} WHERE event_type LIKE 'account:%' AND {_SINCE} GROUP BY dt")
def account_events(t: Tables) -> DataFrame:
    rows = t.account_events.where(F.col("event_type").isin([f"account:{e}" for e in _EVENTS]) & (F.col("dt") >= F.date_sub(day(), DAYS)))
    return rows.groupBy("dt").agg(*(F.sum(F.when(F.col("event_type") == f"account:{e}", F.col("n")).otherwise(0)).alias(e) for e in _EVENTS))


@query(
    "q10_host_weekly_cumulative",
    "WITH w AS (SELECT host, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS new_accounts FROM {creations} GROUP BY 1, 2) SELECT host, week, new_accounts, CAST(sum(new_accounts) OVER (PARTITION BY host ORDER BY week) AS BIGINT) AS cumulative FROM w",
)
def host_weekly_cumulative(t: Tables) -> DataFrame:
    weekly = t.creations.groupBy("host", week(F.col("ts")).alias("week")).agg(F.count("*").alias("new_accounts"))
    return weekly.withColumn("cumulative", F.sum("new_accounts").over(Window.partitionBy("host").orderBy("week")))


@query(
    "q11_lang_activity",
    f"WITH u AS (SELECT did, bit_or(mask) AS mask FROM {_CLEAN} GROUP BY 1) SELECT lang, count(DISTINCT l.did) AS active_users, CAST(sum(posts) AS BIGINT) AS lifetime_posts, {r.rnd('1.0::DOUBLE * sum(posts) / count(DISTINCT l.did)', 1)} AS avg_posts, {_MASKS} FROM {{did_langs}} l JOIN u ON l.did = u.did GROUP BY lang ORDER BY active_users DESC, lang LIMIT 40",
)
def lang_activity(t: Tables) -> DataFrame:
    """The forty languages with most active users; did_langs has a row for each account and language."""
    users = masks(t).groupBy("did").agg(F.bit_or("mask").alias("mask"))
    by = t.did_langs.join(users, "did").groupBy("lang").agg(F.count("*").alias("active_users"), F.sum("posts").alias("lifetime_posts"), round_to(F.sum("posts") / F.count("*"), 1).alias("avg_posts"), *(F.sum(flag(has(F.col("mask"), b))).alias(n) for n, b in BITS.items()))
    return by.orderBy(F.desc("active_users"), "lang").limit(40)


@query(
    "q12_migration_activity",
    f"WITH b AS (SELECT a.did, CASE WHEN m.did IS NULL THEN 'non-migrated' ELSE 'migrated' END AS segment FROM {{accounts}} a LEFT JOIN {{repo_status}} s ON a.did = s.did LEFT JOIN (SELECT DISTINCT did FROM {{migrations}}) m ON a.did = m.did WHERE s.did IS NULL), u AS (SELECT did, count(DISTINCT dt) AS days, bit_or(mask) AS mask FROM {{activity}} WHERE {_SINCE} GROUP BY 1) SELECT segment, count(*) AS total_repos, count(u.did) AS active_users, {r.pct('count(u.did)', 'count(*)')} AS pct_active, {r.rnd('avg(coalesce(days, 0))', 2)} AS avg_active_days, "
    + ", ".join(f"{r.pct(r.long_sum(f'mask & {x} <> 0'), 'count(*)')} AS pct_{n}" for n, x in BITS.items())
    + " FROM b LEFT JOIN u ON b.did = u.did GROUP BY 1",
)
def migration_activity(t: Tables) -> DataFrame:
    base = t.accounts.select("did").join(t.repo_status, "did", "left_anti").join(t.migrations.select("did").distinct().withColumn("moved", F.lit(True)), "did", "left")
    users = t.activity.where(F.col("dt") >= F.date_sub(day(), DAYS)).groupBy("did").agg(F.count("*").alias("days"), F.bit_or("mask").alias("mask"))
    rows = base.join(users, "did", "left").withColumn("segment", F.when(F.col("moved"), "migrated").otherwise("non-migrated"))
    active = F.count("days")
    return rows.groupBy("segment").agg(
        F.count("*").alias("total_repos"), active.alias("active_users"), percent(active, F.count("*")).alias("pct_active"), round_to(F.avg(F.coalesce("days", F.lit(0))), 2).alias("avg_active_days"), *(percent(F.sum(flag(has(F.col("mask"), b))), F.count("*")).alias(f"pct_{n}") for n, b in BITS.items())
    )


DEPTH = {f"depth_{k}": (k, k) for k in (1, 2, 3, 4)}
_DEPTH_SQL = " + ".join(f"CASE WHEN mask & {b} <> 0 THEN 1 ELSE 0 END" for b in BITS.values())


@query(
    "q13_engagement_depth",
    f"WITH u AS (SELECT did, bit_or(mask) AS mask FROM {_DAILY} GROUP BY 1), b AS (SELECT {_BUCKET} AS age_bucket, {_DEPTH_SQL} AS n FROM u JOIN {{cohort}} c ON u.did = c.did) SELECT age_bucket, count(*) AS active_users, {r.rnd('avg(n)', 3)} AS avg_distinct_types, {_ranges_sql('n', DEPTH)}, {r.pct(r.long_sum('n = 4'), 'count(*)')} AS pct_full_depth FROM b GROUP BY 1",
)
def engagement_depth(t: Tables) -> DataFrame:
    used = F.bit_count(F.col("mask").bitwiseAND(F.lit(sum(BITS.values()))))
    users = window(t).groupBy("did").agg(F.bit_or("mask").alias("mask")).join(cohort(t), "did").withColumn("n", used)
    return users.groupBy("age_bucket").agg(F.count("*").alias("active_users"), round_to(F.avg("n"), 3).alias("avg_distinct_types"), *_ranges("n", DEPTH), percent(F.sum(flag(F.col("n") == 4)), F.count("*")).alias("pct_full_depth"))


@query("q14_starter_packs", "SELECT uri, CAST(sum(n) AS BIGINT) AS total_joins, min(dt) AS first_recorded, max(dt) AS last_recorded, count(dt) AS days_with_data FROM {pack_joins} GROUP BY uri ORDER BY total_joins DESC, uri LIMIT 50")
def starter_packs(t: Tables) -> DataFrame:
    by = t.pack_joins.groupBy("uri").agg(F.sum("n").alias("total_joins"), F.min("dt").alias("first_recorded"), F.max("dt").alias("last_recorded"), F.count("dt").alias("days_with_data"))
    return by.orderBy(F.desc("total_joins"), "uri").limit(50)


@query(
    "q15_ns_retention",
    f"WITH a AS (SELECT DISTINCT did FROM {{activity}} WHERE {_SINCE}), c AS (SELECT collection, count(DISTINCT k.did) AS users, count(DISTINCT a.did) AS active FROM {{collections}} k LEFT JOIN a ON k.did = a.did WHERE collection NOT LIKE 'core.%' GROUP BY 1 HAVING count(DISTINCT k.did) >= 2) SELECT split_part(collection, '.', 1) || '.' || split_part(collection, '.', 2) AS namespace, CAST(sum(users) AS BIGINT) AS users_sum, CAST(sum(active) AS BIGINT) AS active_sum, {r.pct('sum(active)', 'sum(users)', 1)} AS pct_retained FROM c GROUP BY 1",
)
def ns_retention(t: Tables) -> DataFrame:
    """Sums over a namespace's collections, so an account counts once for each collection that it uses."""
    active = t.activity.where(F.col("dt") >= F.date_sub(day(), DAYS)).select("did").distinct().withColumn("on", F.lit(1))
    users = t.collections.where(~F.col("collection").like("core.%")).select("collection", "did").distinct().join(active, "did", "left")
    by = users.groupBy("collection").agg(F.count("*").alias("users"), F.count("on").alias("active")).where("users >= 2")
    return by.groupBy(namespace(F.col("collection")).alias("namespace")).agg(F.sum("users").alias("users_sum"), F.sum("active").alias("active_sum"), percent(F.sum("active"), F.sum("users"), 1).alias("pct_retained"))


def _users_sql(bits: dict[str, int]) -> str:
    return ", ".join(f"count(DISTINCT CASE WHEN mask & {b} <> 0 THEN a.did END) AS {n}" for n, b in bits.items())


DAILY_BITS = {"unique_likers": LIKE, "unique_followers": FOLLOW, "unique_posters": POST}


@query("q16_daily_actions_by_cohort", f"SELECT dt, {_BUCKET} AS age_bucket, count(DISTINCT a.did) AS dau, {_users_sql(DAILY_BITS)} FROM {{activity}} a JOIN {{cohort}} c ON a.did = c.did WHERE {_SINCE} GROUP BY 1, 2")
def daily_actions_by_cohort(t: Tables) -> DataFrame:
    rows = t.activity.where(F.col("dt") >= F.date_sub(day(), DAYS)).join(cohort(t), "did")
    return mask_users(rows, ["dt", "age_bucket"], "did", "mask", DAILY_BITS).withColumnRenamed("users", "dau")


GAPS = {"gap_1d": (1, 1), "gap_2_3d": (2, 3), "gap_4_7d": (4, 7), "gap_8_14d": (8, 14), "gap_15plus_d": (15, None)}
_GAP = f"(SELECT did, dt, mask, dt - lag(dt) OVER (PARTITION BY did ORDER BY dt) AS gap FROM {_ALL_DAILY})"


def _gap_columns(ranges: dict[str, tuple[int, int | None]]) -> list[Column]:
    return [F.count_distinct("did").alias("users"), F.count("*").alias("gap_observations"), round_to(F.avg("gap"), 2).alias("avg_gap_days"), round_to(spread(F.col("gap")), 2).alias("stddev_gap_days"), *_ranges("gap", ranges)]


def _gap_sql(ranges: dict[str, tuple[int, int | None]]) -> str:
    return f"count(DISTINCT g.did) AS users, count(*) AS gap_observations, {r.rnd('avg(gap)', 2)} AS avg_gap_days, {r.rnd(r.spread('gap'), 2)} AS stddev_gap_days, {_ranges_sql('gap', ranges)}"


@query("q17_inter_visit_gaps", f"SELECT {_BUCKET} AS age_bucket, {_gap_sql(GAPS)}, {r.pct(r.long_sum('gap = 1'), 'count(*)', 1)} AS pct_next_day FROM {_GAP} g JOIN {{cohort}} c ON g.did = c.did WHERE gap IS NOT NULL GROUP BY 1")
def inter_visit_gaps(t: Tables) -> DataFrame:
    gaps = day_gap(window(t, LOOKBACK), ["did"], "dt").join(cohort(t), "did")
    return gaps.groupBy("age_bucket").agg(*_gap_columns(GAPS), percent(F.sum(flag(F.col("gap") == 1)), F.count("*"), 1).alias("pct_next_day"))


CADENCE = {"gap_1d": (1, 1), "gap_2_3d": (2, 3), "gap_4_7d": (4, 7), "gap_8plus_d": (8, None)}
_ACTIONS = {"post": 1, "like": 2, "repost": 4, "follow": 8}
_CADENCE = " UNION ALL ".join(f"SELECT '{a}' AS action, did, dt - lag(dt) OVER (PARTITION BY did ORDER BY dt) AS gap FROM {_ALL_DAILY} WHERE mask & {b} <> 0" for a, b in _ACTIONS.items())


@query("q18_action_cadence", f"WITH g AS ({_CADENCE}) SELECT {_BUCKET} AS age_bucket, action, {_gap_sql(CADENCE)} FROM g JOIN {{cohort}} c ON g.did = c.did WHERE gap IS NOT NULL GROUP BY 1, 2")
def action_cadence(t: Tables) -> DataFrame:
    """The bits of a mask become rows, so one window serves all actions."""
    actions = F.filter(F.array(*(F.when(has(F.col("mask"), b), F.lit(a)) for a, b in _ACTIONS.items())), lambda x: x.isNotNull())
    rows = window(t, LOOKBACK).select("did", "dt", F.explode(actions).alias("action"))
    return day_gap(rows, ["did", "action"], "dt").join(cohort(t), "did").groupBy("age_bucket", "action").agg(*_gap_columns(CADENCE))


SEEN = {"seen_yesterday": (0, 1), "seen_2_7d": (2, 7), "seen_8_30d": (8, 30), "seen_31plus_d": (31, None)}


@query("q19_recency", f"WITH l AS (SELECT did, DATE '{AS_OF}' - max(dt) AS ago FROM {_ALL_DAILY} GROUP BY 1) SELECT {_BUCKET} AS age_bucket, count(*) AS users, {r.rnd('avg(ago)', 1)} AS avg_days_since, {_ranges_sql('ago', SEEN)} FROM l JOIN {{cohort}} c ON l.did = c.did GROUP BY 1")
def recency(t: Tables) -> DataFrame:
    """Whole days, so that every account falls into a class."""
    last = window(t, LOOKBACK).groupBy("did").agg(F.datediff(day(), F.max("dt")).alias("ago")).join(cohort(t), "did")
    return last.groupBy("age_bucket").agg(F.count("*").alias("users"), round_to(F.avg("ago"), 1).alias("avg_days_since"), *_ranges("ago", SEEN))


@query(
    "q20_new_user_follow_like",
    f"WITH n AS (SELECT dt, count(DISTINCT a.did) AS new_user_dau, count(DISTINCT CASE WHEN mask & 10 = 8 THEN a.did END) AS followed_only, count(DISTINCT CASE WHEN mask & 10 = 10 THEN a.did END) AS followed_and_liked, count(DISTINCT CASE WHEN mask & 8 <> 0 THEN a.did END) AS f FROM {{activity}} a JOIN {{cohort}} c ON a.did = c.did WHERE {_SINCE} AND created >= DATE '{AS_OF}' - {DAYS} GROUP BY 1) SELECT dt, new_user_dau, followed_only, followed_and_liked, {r.pct('followed_only', 'f', 1)} AS pct_followed_only, {r.pct('followed_and_liked', 'f', 1)} AS pct_followed_and_liked FROM n",
)
def new_user_follow_like(t: Tables) -> DataFrame:
    """activity has one row for each account and day, so rows are users."""
    since, both = F.date_sub(day(), DAYS), F.col("mask").bitwiseAND(F.lit(LIKE | FOLLOW))
    rows = t.activity.where(F.col("dt") >= since).join(t.cohort.where(F.col("created") >= since), "did")
    n = rows.groupBy("dt").agg(F.count("*").alias("new_user_dau"), F.sum(flag(both == FOLLOW)).alias("followed_only"), F.sum(flag(both == LIKE | FOLLOW)).alias("followed_and_liked"), F.sum(flag(has(F.col("mask"), FOLLOW))).alias("f"))
    return n.withColumns({f"pct_{c}": percent(F.col(c), F.col("f"), 1) for c in ("followed_only", "followed_and_liked")}).drop("f")


@query(
    "q21_dau_mau",
    f"WITH c AS (SELECT a.did, dt FROM {{activity}} a LEFT JOIN {{excluded}} x ON a.did = x.did WHERE x.did IS NULL), d AS (SELECT dt, count(DISTINCT did) AS dau FROM c WHERE dt >= DATE '{AS_OF}' - {TREND} GROUP BY 1), m AS (SELECT d.dt, count(DISTINCT c.did) AS mau FROM d JOIN c ON c.dt BETWEEN d.dt - {MAU - 1} AND d.dt GROUP BY 1) SELECT dt, dau, mau, {r.pct('dau', 'mau')} AS dau_mau_pct FROM d JOIN m USING (dt)",
)
def dau_mau(t: Tables) -> DataFrame:
    clean = anti_exclude(t.activity.where(F.col("dt") >= F.date_sub(day(), TREND + MAU)), t.excluded, "did")
    mau = trailing_distinct(clean, "dt", "did", MAU).withColumnRenamed("users", "mau")
    dau = clean.where(F.col("dt") >= F.date_sub(day(), TREND)).groupBy("dt").agg(F.count("*").alias("dau"))
    return dau.join(mau, "dt").withColumn("dau_mau_pct", percent(F.col("dau"), F.col("mau")))


@query("q22_wau_by_cohort", f"SELECT CAST(date_trunc('week', dt) AS DATE) AS week_start, {_BUCKET} AS age_bucket, count(DISTINCT a.did) AS wau FROM {_DAILY} a JOIN {{cohort}} c ON a.did = c.did GROUP BY 1, 2")
def wau_by_cohort(t: Tables) -> DataFrame:
    return window(t).join(cohort(t), "did").groupBy(week(F.col("dt")).alias("week_start"), "age_bucket").agg(F.count_distinct("did").alias("wau"))


@query("q22b_wau_compatible_weeks", f"SELECT CAST(date_trunc('week', dt - 1) AS DATE) AS week_start, {_BUCKET} AS age_bucket, count(DISTINCT a.did) AS wau FROM {_DAILY} a JOIN {{cohort}} c ON a.did = c.did GROUP BY 1, 2")
def wau_compatible(t: Tables) -> DataFrame:
    """Weeks from Tuesday to Monday, named by the Monday before them."""
    return window(t).join(cohort(t), "did").groupBy(week_before(F.col("dt")).alias("week_start"), "age_bucket").agg(F.count_distinct("did").alias("wau"))


@query("q23_mau_by_cohort", f"SELECT strftime(dt, '%Y-%m') AS month, {_BUCKET} AS age_bucket, count(DISTINCT a.did) AS mau FROM {_DAILY} a JOIN {{cohort}} c ON a.did = c.did GROUP BY 1, 2")
def mau_by_cohort(t: Tables) -> DataFrame:
    return window(t).join(cohort(t), "did").groupBy(month(F.col("dt")).alias("month"), "age_bucket").agg(F.count_distinct("did").alias("mau"))


@query(
    "q24_new_user_activation_28d",
    f"WITH n AS (SELECT c.did, created, min(dt) AS f FROM {{cohort}} c LEFT JOIN {{activity}} a ON a.did = c.did AND dt BETWEEN created AND created + 27 WHERE created >= DATE '{AS_OF}' - 90 AND created <= DATE '{AS_OF}' - 7 GROUP BY 1, 2) SELECT CAST(date_trunc('week', created) AS DATE) AS creation_week, count(*) AS new_accounts, count(f) AS activated, {r.pct('count(f)', 'count(*)')} AS pct_activated, {r.long_sum('f = created')} AS activated_d0, {r.long_sum('f > created AND f <= created + 6')} AS activated_d1_6, {r.long_sum('f > created + 6')} AS activated_d7_27 FROM n GROUP BY 1",
)
def new_user_activation(t: Tables) -> DataFrame:
    new = t.cohort.where((F.col("created") >= F.date_sub(day(), 90)) & (F.col("created") <= F.date_sub(day(), 7)))
    seen = within_n_days(new, t.activity, "did", "created", "dt", 28).withColumn("after", F.datediff("first_active", "created"))
    return seen.groupBy(week(F.col("created")).alias("creation_week")).agg(F.count("*").alias("new_accounts"), F.count("after").alias("activated"), percent(F.count("after"), F.count("*")).alias("pct_activated"), *_ranges("after", {"activated_d0": (0, 0), "activated_d1_6": (1, 6), "activated_d7_27": (7, None)}))


@query("q25_creation_weekly", "SELECT CAST(date_trunc('week', created) AS DATE) AS week, count(*) AS new_accounts FROM {cohort} GROUP BY 1")
def creation_weekly(t: Tables) -> DataFrame:
    return t.cohort.groupBy(week(F.col("created")).alias("week")).agg(F.count("*").alias("new_accounts"))


START, END, NS = "2024-01-01", "2024-01-22", (1, 3, 7)
_KEPT = "(SELECT c.did, c.created, c.host, c.host_type, " + ", ".join(f"max(CASE WHEN a.dt = c.created + {n} THEN 1 ELSE 0 END) AS d{n}" for n in NS) + f" FROM {{cohort}} c LEFT JOIN {{activity}} a ON a.did = c.did WHERE created BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1, 2, 3, 4)"
_RATES = "count(*) AS cohort_size, " + ", ".join(f"CAST(coalesce(sum(d{n}), 0) AS BIGINT) AS d{n}_n, {r.pct(f'sum(d{n})', 'count(*)')} AS d{n}_pct" for n in NS)


def _retained(t: Tables) -> DataFrame:
    return day_n_retention(t.cohort.where(F.col("created").between(day(START), day(END))), t.activity, "did", "created", "dt", NS)


def _rates() -> list[Column]:
    return [F.count("*").alias("cohort_size"), *(x for n in NS for x in (F.coalesce(F.sum(f"d{n}"), F.lit(0)).alias(f"d{n}_n"), percent(F.sum(f"d{n}"), F.count("*")).alias(f"d{n}_pct")))]


@query("q26_retention_by_day", f"WITH k AS {_KEPT} SELECT created, host_type, {_RATES} FROM k GROUP BY 1, 2 UNION ALL SELECT created, '~ total', {_RATES} FROM k GROUP BY 1")
def retention_by_day(t: Tables) -> DataFrame:
    return with_total(_retained(t), ["created", "host_type"], _rates(), {"host_type": "~ total"})


@query("q27_retention_aggregate", f"WITH k AS {_KEPT} SELECT host_type, {_RATES} FROM k GROUP BY 1 UNION ALL SELECT '~ total', {_RATES} FROM k")
def retention_aggregate(t: Tables) -> DataFrame:
    return with_total(_retained(t), ["host_type"], _rates(), {"host_type": "~ total"})


@query("q28_retention_by_host", f"WITH k AS {_KEPT} SELECT host, {_RATES} FROM k WHERE host_type = 'indie' GROUP BY 1 HAVING count(*) >= 10 ORDER BY cohort_size DESC, host LIMIT 50")
def retention_by_host(t: Tables) -> DataFrame:
    by = _retained(t).where("host_type = 'indie'").groupBy("host").agg(*_rates()).where("cohort_size >= 10")
    return by.orderBy(F.desc("cohort_size"), "host").limit(50)


@query("q29_excluded", "SELECT did FROM {repo_status} UNION SELECT did FROM {account_labels} WHERE label IN ('spam', 'impersonation')")
def excluded_accounts(t: Tables) -> DataFrame:
    return t.repo_status.select("did").union(t.account_labels.where(F.col("label").isin("spam", "impersonation")).select("did")).distinct()


@query("q30_cohort_base", "SELECT a.did, a.created, a.host, CASE WHEN a.host LIKE '%.core.network%' THEN 'core' ELSE 'indie' END AS host_type FROM {accounts} a WHERE a.did NOT IN (SELECT did FROM {repo_status} UNION SELECT did FROM {account_labels} WHERE label IN ('spam', 'impersonation'))")
def cohort_base(t: Tables) -> DataFrame:
    kept = anti_exclude(t.accounts, excluded_accounts(t), "did")
    return kept.select("did", "created", "host", F.when(F.col("host").contains(".core.network"), "core").otherwise("indie").alias("host_type"))


@query(
    "q71_top_hosts_else_other",
    "WITH w AS (SELECT host, CAST(date_trunc('week', created) AS DATE) AS week, count(*) AS n FROM {cohort} GROUP BY 1, 2), top AS (SELECT host FROM w GROUP BY 1 ORDER BY sum(n) DESC, host LIMIT 5), l AS (SELECT week, CASE WHEN host IN (SELECT host FROM top) THEN host ELSE 'Other' END AS host, n FROM w), g AS (SELECT week, host, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1, 2) SELECT week, host, n, "
    + r.pct("n", "sum(n) OVER (PARTITION BY week)", 1)
    + " AS pct, CAST(sum(n) OVER (PARTITION BY host ORDER BY week ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM g",
)
def stacked_area(t: Tables) -> DataFrame:
    """Weekly creations of the largest hosts and of all others, each week's shares, and running totals."""
    weekly = t.cohort.groupBy("host", week(F.col("created")).alias("week")).agg(F.count("*").alias("n"))
    g = topn_else_other(weekly, "host", "n", 5).groupBy("week", "host").agg(F.sum("n").alias("n"))
    running = Window.partitionBy("host").orderBy("week").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.withColumns({"pct": percent(F.col("n"), F.sum("n").over(Window.partitionBy("week")), 1), "cumulative": F.sum("n").over(running)})
