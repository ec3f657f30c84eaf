"""What collectors derive from logs and event streams, as batch queries; starlane.streaming has the same folds over streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.functions.expr import flag, percent, round_to, uniform
from starlane.operators.archetypes import detect_changes, latest_per_key
from starlane.operators.graph import ranked
from starlane.plans import registry as r
from starlane.plans.registry import query
from starlane.sources.bindings import Tables

EVENT_BITS = {"click": 1, "view": 2, "purchase": 4, "signup": 8}
OTHER_BIT = 16


def event_bit(kind: Column) -> Column:
    out = F
    for name, bit in EVENT_BITS.items():
        out = out.when(kind == name, F.lit(bit))
    return out.otherwise(F.lit(OTHER_BIT))


def changes(t: Tables) -> DataFrame:
    return detect_changes(t.oplog.where(~F.col("nullified")), "did", ["ts", "op_id"], "host")


@query("q74_migrations", "SELECT did, op_id, from_host, to_host, ts FROM {migrations}")
def migrations(t: Tables) -> DataFrame:
    """A move is an operation with another host than the account's last."""
    return changes(t).where("nth > 1").select("did", "op_id", F.col("before").alias("from_host"), F.col("host").alias("to_host"), "ts")


@query("q75_creations", "SELECT did, arg_min(host, (ts, op_id)) AS host, min(ts) AS created FROM {oplog} WHERE NOT nullified GROUP BY 1")
def creations(t: Tables) -> DataFrame:
    at = F.struct("ts", "op_id")
    return t.oplog.where(~F.col("nullified")).groupBy("did").agg(F.min_by("host", at).alias("host"), F.min("ts").alias("created"))


@query("q76_current_handles", "SELECT did, arg_max(handle, (ts, op_id)) AS handle, max(ts) AS updated FROM {oplog} WHERE NOT nullified GROUP BY 1")
def current_handles(t: Tables) -> DataFrame:
    """The last one written stays."""
    at = F.struct("ts", "op_id")
    return t.oplog.where(~F.col("nullified")).groupBy("did").agg(F.max_by("handle", at).alias("handle"), F.max("ts").alias("updated"))


@query("q77_nullified_tally", f"SELECT year(ts) AS year, count(*) AS operations, {r.long_sum('nullified')} AS nullified, {r.pct(r.long_sum('nullified'), 'count(*)')} AS pct_nullified FROM {{oplog}} GROUP BY 1")
def nullified_tally(t: Tables) -> DataFrame:
    n = F.sum(flag(F.col("nullified")))
    return t.oplog.groupBy(F.year("ts").cast("long").alias("year")).agg(F.count("*").alias("operations"), n.alias("nullified"), percent(n, F.count("*")).alias("pct_nullified"))


@query(
    "q78_host_scan_tally",
    f"SELECT h.host, count(*) AS total, {r.long_sum('s.did IS NULL')} AS active, {r.long_sum(chr(39).join(['status = ', 'deactivated', '']))} AS deactivated, {r.long_sum(chr(39).join(['status = ', 'takendown', '']))} AS takendown, {r.long_sum(chr(39).join(['status = ', 'deleted', '']))} AS deleted FROM {{current_host}} h LEFT JOIN {{repo_status}} s ON h.did = s.did GROUP BY 1",
)
def host_scan_tally(t: Tables) -> DataFrame:
    rows = t.current_host.join(t.repo_status, "did", "left")
    return rows.groupBy("host").agg(F.count("*").alias("total"), F.sum(flag(F.col("status").isNull())).alias("active"), *(F.sum(flag(F.col("status") == s)).alias(s) for s in ("deactivated", "takendown", "deleted")))


@query(
    "q79_sample_stats",
    f"""WITH e AS (SELECT event_type, user_id, ts FROM {{events}} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00')
    SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, {r.rnd('count(*) / 86400.0::DOUBLE', 6)} AS per_second, {r.pct('count(*)', 'sum(count(*)) OVER ()')} AS pct FROM e GROUP BY 1""",
)
def sample_stats(t: Tables) -> DataFrame:
    """A bounded slice of the stream: rates, users and shares by kind of event."""
    day = t.events.where("ts >= timestamp_ntz '2024-01-10 00:00:00' AND ts < timestamp_ntz '2024-01-11 00:00:00'")
    by = day.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return by.withColumns({"per_second": round_to(F.col("n") / 86400.0, 6), "pct": percent(F.col("n"), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))})


def folds(events: DataFrame) -> DataFrame:
    """Every fold over the stream in one pass, in long form: metric, key, day, n (counts) and mask (bits seen).

    One event goes to several keyed sums; the same function serves batch and stream.
    """
    key = lambda name, k: F.struct(F.lit(name).alias("metric"), k.cast("string").alias("key"))
    is_a = lambda kind, s: F.when(F.col("event_type") == kind, s)
    out = F.filter(F.array(key("account", F.col("user_id")), key("kind", F.col("event_type")), is_a("error", key("deletes", F.col("user_id"))), is_a("signup", key("pack", F.floor(F.col("user_id") / 3)))), lambda x: x.isNotNull())
    rows = events.select(F.to_date("ts").alias("day"), event_bit(F.col("event_type")).alias("bit"), F.explode(out).alias("k"))
    return rows.groupBy(F.col("k.metric").alias("metric"), F.col("k.key").alias("key"), "day").agg(F.count("*").alias("n"), F.bit_or("bit").alias("mask"))


_BIT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {b}" for k, b in EVENT_BITS.items()) + f" ELSE {OTHER_BIT} END"


@query(
    "q80_daily_folds",
    f"""WITH e AS (SELECT *, CAST(ts AS DATE) AS day, {_BIT} AS bit FROM {{events}}), f AS (
    SELECT 'account' AS metric, CAST(user_id AS VARCHAR) AS key, day, bit FROM e UNION ALL SELECT 'kind', event_type, day, bit FROM e
    UNION ALL SELECT 'deletes', CAST(user_id AS VARCHAR), day, bit FROM e WHERE event_type = 'error' UNION ALL SELECT 'pack', CAST(CAST(floor(user_id / 3.0) AS BIGINT) AS VARCHAR), day, bit FROM e WHERE event_type = 'signup')
    SELECT metric, key, day, count(*) AS n, CAST(bit_or(bit) AS INTEGER) AS mask FROM f GROUP BY 1, 2, 3""",
)
def daily_folds(t: Tables) -> DataFrame:
    return folds(t.events)


@query("q81_label_distribution", "SELECT label, count(*) AS n, count(DISTINCT did) AS accounts, min(labeled) AS first_labeled FROM {account_labels} GROUP BY 1")
def label_distribution(t: Tables) -> DataFrame:
    rows = t.account_labels.dropDuplicates(["did", "label"])
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count("*").alias("accounts"), F.min("labeled").alias("first_labeled"))


@query(
    "q82_worklist",
    "WITH w AS (SELECT uri, CAST(sum(n) AS BIGINT) AS seen, max(dt) AS last FROM {pack_joins} GROUP BY 1), d AS (SELECT uri, seen, last, CASE WHEN seen % 3 = 0 THEN 'done' ELSE 'pending' END AS status FROM w) SELECT uri, seen, last, row_number() OVER (ORDER BY seen DESC, uri) AS place FROM d WHERE status = 'pending'",
)
def worklist(t: Tables) -> DataFrame:
    """What is still to be fetched, the largest first; numbered in range partitions."""
    by = t.pack_joins.groupBy("uri").agg(F.sum("n").alias("seen"), F.max("dt").alias("last")).where("seen % 3 <> 0")
    return ranked(by, [F.desc("seen"), F.col("uri")], "place")


RETRY_BASE, RETRY_MOST = 5, 480


@query("sk19_retry_schedule", f"WITH e AS (SELECT event_id, CAST(event_id % 12 AS INTEGER) AS attempts FROM {{events}} WHERE event_type = 'error') SELECT event_id, attempts, least((attempts + 1) * (attempts + 1) * {RETRY_BASE}, {RETRY_MOST}) AS retry_minutes FROM e WHERE attempts < 10")
def retry_schedule(t: Tables) -> DataFrame:
    """Back-off of a dead-letter queue: squares of attempts, bounded; ten attempts are all."""
    failed = t.events.where("event_type = 'error'").select("event_id", (F.col("event_id") % 12).cast("int").alias("attempts")).where("attempts < 10")
    n = F.col("attempts") + 1
    return failed.withColumn("retry_minutes", F.least(n * n * RETRY_BASE, F.lit(RETRY_MOST)))


ATTEMPTS, NOW = 10, "2024-01-15 00:00:00"


def after_retry(queue: DataFrame, now: Column, sent: Column) -> DataFrame:
    """A dead-letter queue after a round at `now`: rows that are due and sent go, those that fail again wait for longer, those not due stay as they are; the last attempt ends a row."""
    n = F.col("attempts") + 1
    due = F.col("due") <= now
    later = now + F.make_dt_interval(mins=F.least((n + 1) * (n + 1) * RETRY_BASE, F.lit(RETRY_MOST)))
    left = queue.where(~(due & sent))
    return left.withColumns({"attempts": F.when(due, n).otherwise(F.col("attempts")), "due": F.when(due, later).otherwise(F.col("due"))}).where(F.col("attempts") < ATTEMPTS)


@query(
    "sm22_retry_round",
    f"""WITH q AS (SELECT event_id, CAST(event_id % 12 AS INTEGER) AS attempts, CAST(ts AS TIMESTAMP) AS due, value > 50 AS sent FROM {{events}} WHERE event_type = 'error' AND event_id % 12 < {ATTEMPTS})
    SELECT event_id, CASE WHEN due <= TIMESTAMP '{NOW}' THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN due <= TIMESTAMP '{NOW}' THEN TIMESTAMP '{NOW}' + to_minutes(least((attempts + 2) * (attempts + 2) * {RETRY_BASE}, {RETRY_MOST})) ELSE due END AS due
    FROM q WHERE NOT (due <= TIMESTAMP '{NOW}' AND sent) AND CASE WHEN due <= TIMESTAMP '{NOW}' THEN attempts + 1 ELSE attempts END < {ATTEMPTS}""",
)
def retry_round(t: Tables) -> DataFrame:
    queue = t.events.where("event_type = 'error'").select("event_id", (F.col("event_id") % 12).cast("int").alias("attempts"), F.col("ts").cast("timestamp").alias("due"), (F.col("value") > 50).alias("sent")).where(F.col("attempts") < ATTEMPTS)
    return after_retry(queue, F.lit(NOW).cast("timestamp"), F.col("sent")).drop("sent")


@query("jn20_latest_label", "SELECT did, label, labeled FROM {account_labels} QUALIFY row_number() OVER (PARTITION BY did ORDER BY labeled DESC, label) = 1")
def latest_label(t: Tables) -> DataFrame:
    return latest_per_key(t.account_labels, ["did"], [F.desc("labeled"), F.col("label")])


@query("src05_event_properties", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM {events} GROUP BY 1")
def event_properties(t: Tables) -> DataFrame:
    """A JSON column read with its schema; what does not parse is null and counted as such."""
    rows = t.events.select(F.from_json("props", "k long")["k"].alias("k"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query(
    "so12_weighted_sample",
    "WITH u AS (SELECT did, bit_or(mask) AS mask, count(*) AS w FROM {activity} GROUP BY 1), g AS (SELECT did, w, ln(w) - ln(-ln((('0x' || substr(md5('42:' || did), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967297.0::DOUBLE)) AS key FROM u) SELECT did, w FROM g ORDER BY key DESC, did LIMIT 20",
)
def weighted_sample(t: Tables) -> DataFrame:
    """Twenty accounts without replacement, likelier by days active: the largest of log weight plus Gumbel noise."""
    u = t.activity.groupBy("did").agg(F.count("*").alias("w"))
    p = (uniform(F.col("did")) * float(1 << 32) + 0.5) / 4294967297.0
    return u.withColumn("key", F.log("w") - F.log(-F.log(p))).orderBy(F.desc("key"), "did").limit(20).select("did", "w")
