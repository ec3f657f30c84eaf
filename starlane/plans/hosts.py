"""Hosts from their scans: latest state with fallbacks, overview, geography, versions, providers, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlane.functions.expr import LAST_SIZE, PROVIDERS, SIZES, bare, behind_cdn, core_host, flag, hostname, percent, provider, public_host, size_bucket
from starlane.operators.archetypes import composite_fallback, latest_per_key, zero_fill
from starlane.operators.graph import ranked
from starlane.plans import registry as r
from starlane.plans.registry import query
from starlane.sources.bindings import Tables

GEO = ["country", "country_code", "city", "lat", "lon", "org"]
PLACE = {"lat": 38.0, "lon": -30.0, "city": "CDN / Host Unknown"}

_FIRST = "QUALIFY row_number() OVER (PARTITION BY u ORDER BY snap DESC, url) = 1"
_SNAP = "(SELECT *, rtrim(url, '/') AS u FROM {snapshots})"
_SCAN = f"(SELECT *, rtrim(url, '/') AS u FROM {{snapshots}} WHERE {r.public_host('url')})"
_LATEST = f"""(SELECT l.u AS host, l.snap, l.total, l.active, l.is_online, l.invite_required, l.ip, b.best_total, b.best_active, coalesce(l.version, v.version) AS version,
    coalesce(l.country, g.country) AS country, coalesce(l.country_code, g.country_code) AS country_code, coalesce(l.city, g.city) AS city, coalesce(l.lat, g.lat) AS lat, coalesce(l.lon, g.lon) AS lon, coalesce(l.org, g.org) AS org, b.in_directory
    FROM (SELECT * FROM {_SCAN} WHERE is_partial = 0 {_FIRST}) l
    JOIN (SELECT u, max(CASE WHEN is_partial = 0 THEN total END) AS best_total, CAST(max(CASE WHEN is_partial = 0 THEN active END) AS BIGINT) AS best_active, max(CASE WHEN in_directory = 1 THEN 1 ELSE 0 END) AS in_directory FROM {_SCAN} GROUP BY 1) b USING (u)
    LEFT JOIN (SELECT * FROM {_SCAN} WHERE version IS NOT NULL AND is_partial = 0 {_FIRST.replace(', url', ', version DESC')}) v USING (u)
    LEFT JOIN (SELECT * FROM {_SCAN} WHERE (country IS NOT NULL OR org IS NOT NULL) AND is_partial = 0 {_FIRST}) g USING (u))"""


def scans(t: Tables) -> DataFrame:
    """Snapshots under their normalised name, complete scans of public hosts only."""
    return t.snapshots.withColumn("host", bare(F.col("url"))).where(public_host(F.col("url")))


def latest(t: Tables) -> DataFrame:
    """One row for each host: its latest complete scan; version and place from the latest scan that had them; best counts ever.

    One aggregation over one reading of the scans; the normalised name is unique. listed is the latest complete scan of a listed host.
    """
    full = F.col("is_partial") == 0
    best = lambda c: F.max(F.when(full, F.col(c))).alias(f"best_{c}")
    listed = F.max(F.when(full & (F.col("in_directory") == 1), F.struct("snap", F.col("is_online").alias("online"), F.col("invite_required").alias("invite")))).alias("listed")
    rows = scans(t).select("host", "snap", "total", "active", "is_online", "invite_required", "ip", "version", *GEO, "is_partial", "in_directory")
    extra = [best("total"), best("active"), F.max(F.when(F.col("in_directory") == 1, 1).otherwise(0)).alias("listed_ever"), listed]
    now = composite_fallback(rows, ["host"], "snap", [["version"], GEO], full, extra)
    return now.drop("is_partial", "in_directory").withColumnRenamed("listed_ever", "in_directory")


@query("q47_latest_scan", f"SELECT u AS host, snap, total, CAST(active AS BIGINT) AS active FROM {_SNAP} {_FIRST}")
def latest_scan(t: Tables) -> DataFrame:
    rows = t.snapshots.withColumn("host", bare(F.col("url")))
    return latest_per_key(rows, ["host"], [F.desc("snap"), F.col("url")]).select("host", "snap", "total", "active")


@query("q47b_latest_scan_with_ties", f"SELECT url, u AS host, snap, total FROM {_SNAP} QUALIFY rank() OVER (PARTITION BY u ORDER BY snap DESC) = 1")
def latest_scan_ties(t: Tables) -> DataFrame:
    rows = t.snapshots.withColumn("host", bare(F.col("url")))
    return latest_per_key(rows, ["host"], [F.desc("snap")], ties=True).select("url", "host", "snap", "total")


@query("q48_last_scan", "SELECT max(snap) AS last_complete, count(*) AS complete_scans FROM {snapshots} WHERE is_partial = 0")
def last_scan(t: Tables) -> DataFrame:
    return t.snapshots.where("is_partial = 0").agg(F.max("snap").alias("last_complete"), F.count("*").alias("complete_scans"))


@query(
    "q51_host_age",
    "WITH c AS (SELECT host, min(CAST(date_trunc('week', ts) AS DATE)) AS f, count(*) AS n FROM {creations} GROUP BY 1), m AS (SELECT to_host AS host, CAST(min(ts) AS DATE) AS f FROM {migrations} GROUP BY 1) SELECT c.host, least(c.f, coalesce(m.f, c.f)) AS first_week, n AS accounts FROM c LEFT JOIN m ON c.host = m.host WHERE n >= 5",
)
def host_age(t: Tables) -> DataFrame:
    """The first sign of each host: a creation's week, or a move to it."""
    c = t.creations.where(public_host(F.col("host"))).groupBy(bare(F.col("host")).alias("host")).agg(F.min(F.date_trunc("week", "ts").cast("date")).alias("f"), F.count("*").alias("accounts")).where("accounts >= 5")
    m = t.migrations.groupBy(bare(F.col("to_host")).alias("host")).agg(F.min("ts").cast("date").alias("m"))
    return c.join(m, "host", "left").select("host", F.least("f", F.coalesce("m", "f")).alias("first_week"), "accounts")


@query("q52_active_hosts", f"SELECT count(*) AS active_hosts, {r.long_sum('mx > 50')} AS large_hosts FROM (SELECT u, max(total) AS mx FROM {_SCAN} GROUP BY 1 HAVING max(total) > 0)")
def active_hosts(t: Tables) -> DataFrame:
    by = scans(t).groupBy("host").agg(F.max("total").alias("mx")).where("mx > 0")
    return by.agg(F.count("*").alias("active_hosts"), F.sum(flag(F.col("mx") > 50)).alias("large_hosts"))


_BACKEND = "CASE WHEN u LIKE '%.core.network' THEN 'core' ELSE coalesce(ip, u) END"


@query(
    "q53_top_hosts_by_scan",
    f"""WITH l AS (SELECT *, {_BACKEND} AS backend FROM (SELECT * FROM {_SNAP} {_FIRST}) WHERE total > 0),
    n AS (SELECT backend, arg_min(u, (length(regexp_replace(u, '^https?://', '')), u)) AS host, max(total) AS repos, CAST(arg_max(active, (total, active)) AS BIGINT) AS active, max(snap) AS snap FROM l WHERE backend <> 'core' GROUP BY 1),
    c AS (SELECT 'https://core.network' AS host, CAST(sum(total) AS BIGINT) AS repos, CAST(sum(active) AS BIGINT) AS active, max(snap) AS snap FROM l WHERE backend = 'core' HAVING count(*) > 0)
    SELECT * FROM (SELECT host, repos, active, snap FROM n UNION ALL SELECT * FROM c) ORDER BY active DESC, host LIMIT 15""",
)
def top_hosts_by_scan(t: Tables) -> DataFrame:
    """Hosts behind one address count as one, under their shortest name, with the largest scan's counts; the platform's hosts are summed."""
    rows = latest_per_key(t.snapshots.withColumn("host", bare(F.col("url"))), ["host"], [F.desc("snap"), F.col("url")]).where("total > 0")
    core = core_host(F.col("host"))
    name = F.min(F.struct(F.length(hostname(F.col("host"))).alias("n"), "host"))["host"]
    largest = F.max(F.struct("total", "active"))
    by = rows.where(~core).groupBy(F.coalesce("ip", "host").alias("backend")).agg(name.alias("host"), largest["total"].alias("repos"), largest["active"].alias("active"), F.max("snap").alias("snap")).drop("backend")
    own = rows.where(core).agg(F.sum("total").alias("repos"), F.sum("active").alias("active"), F.max("snap").alias("snap")).where("repos is not null").select(F.lit("https://core.network").alias("host"), "repos", "active", "snap")
    return by.unionByName(own).orderBy(F.desc("active"), "host").limit(15)


@query("q54_core_shards", f"SELECT u AS host, max(total) AS repos FROM (SELECT *, max(snap) OVER (PARTITION BY u) AS last FROM {_SNAP}) WHERE snap = last AND u LIKE '%.core.network' GROUP BY 1")
def core_shards(t: Tables) -> DataFrame:
    rows = t.snapshots.withColumn("host", bare(F.col("url"))).where(core_host(F.col("url")))
    return rows.groupBy("host").agg(F.max(F.struct("snap", "total"))["total"].alias("repos"))


@query("q58_latest_state", f"SELECT host, snap, total, CAST(active AS BIGINT) AS active, best_total, best_active, version, country, country_code, city, lat, lon, org, in_directory FROM {_LATEST}")
def latest_state(t: Tables) -> DataFrame:
    return latest(t).select("host", "snap", "total", "active", "best_total", "best_active", "version", "country", "country_code", "city", "lat", "lon", "org", "in_directory")


_ONE = f"(SELECT * FROM {_SCAN} WHERE in_directory = 1 AND is_partial = 0 {_FIRST})"


@query(
    "q59_overview",
    f"""WITH d AS (SELECT count(*) AS total, {r.long_sum('is_online = 1')} AS online, {r.long_sum('is_online = 0')} AS offline, {r.long_sum('invite_required = 0')} AS open_registration, {r.long_sum('invite_required <> 0 OR invite_required IS NULL')} AS invite_only FROM {_ONE}),
    p AS {_LATEST}, b AS (SELECT CASE WHEN org LIKE '%Cloudflare%' THEN host ELSE coalesce(ip, host) END AS backend, max(best_total) AS n, max(best_active) AS a FROM p GROUP BY 1),
    g AS (SELECT count(DISTINCT country_code) AS countries FROM p)
    SELECT total, online, offline, open_registration, invite_only, countries, CAST(sum(n) AS BIGINT) AS users, CAST(sum(a) AS BIGINT) AS active FROM d, g, b GROUP BY 1, 2, 3, 4, 5, 6""",
)
def overview(t: Tables) -> DataFrame:
    """One row: listed hosts by state, countries, and users with hosts behind one address counted once."""
    p = latest(t)
    is_ = lambda c: F.sum(flag(F.col("listed").isNotNull() & c))
    online, invite = F.col("listed.online"), F.col("listed.invite")
    d = p.agg(is_(F.lit(True)).alias("total"), is_(online == 1).alias("online"), is_(online == 0).alias("offline"), is_(invite == 0).alias("open_registration"), is_((invite != 0) | invite.isNull()).alias("invite_only"), F.count_distinct("country_code").alias("countries"))
    backend = F.when(F.col("org").contains("Cloudflare"), F.col("host")).otherwise(F.coalesce("ip", "host"))
    b = p.groupBy(backend.alias("backend")).agg(F.max("best_total").alias("n"), F.max("best_active").alias("a")).agg(F.sum("n").alias("users"), F.sum("a").alias("active"))
    return d.crossJoin(F.broadcast(b)).select("total", "online", "offline", "open_registration", "invite_only", "countries", "users", "active")


@query("q60_countries", f"SELECT country, country_code, count(*) AS n FROM {_LATEST} WHERE country IS NOT NULL GROUP BY 1, 2")
def countries(t: Tables) -> DataFrame:
    return latest(t).where("country is not null").groupBy("country", "country_code").agg(F.count("*").alias("n"))


@query("q60b_repos_by_country", f"SELECT country, country_code, CAST(sum(total) AS BIGINT) AS repos FROM {_LATEST} WHERE country IS NOT NULL AND total > 0 GROUP BY 1, 2")
def repos_by_country(t: Tables) -> DataFrame:
    return latest(t).where("country is not null AND total > 0").groupBy("country", "country_code").agg(F.sum("total").alias("repos"))


@query("q61_versions", f"SELECT coalesce(version, 'unknown') AS version, count(*) AS n FROM {_LATEST} WHERE in_directory = 1 GROUP BY coalesce(version, 'unknown')")
def versions(t: Tables) -> DataFrame:
    return latest(t).where("in_directory = 1").groupBy(F.coalesce("version", F.lit("unknown")).alias("version")).agg(F.count("*").alias("n"))


_PROVIDER = "CASE WHEN org IS NULL OR org = '' THEN 'Unknown' " + " ".join("WHEN " + " OR ".join(f"org LIKE '%{p}%'" for p in parts) + f" THEN '{name}'" for name, parts in PROVIDERS) + " ELSE org END"
_CDN = "coalesce(org LIKE '%Cloudflare%' OR org LIKE '%Fastly%', false)"


@query("q62_providers", f"SELECT {_PROVIDER} AS provider, {_CDN} AS is_cdn, count(*) AS n FROM {_LATEST} WHERE in_directory = 1 GROUP BY 1, 2")
def providers(t: Tables) -> DataFrame:
    return latest(t).where("in_directory = 1").groupBy(provider(F.col("org")).alias("provider"), behind_cdn(F.col("org")).alias("is_cdn")).agg(F.count("*").alias("n"))


_NAMED = "org IS NOT NULL AND org <> ''"


@query("q62b_cdn_breakdown", f"SELECT {r.long_sum(_CDN)} AS behind_cdn, {r.long_sum(f'{_NAMED} AND NOT {_CDN}')} AS direct, {r.long_sum(f'NOT ({_NAMED})')} AS unknown FROM {_LATEST} WHERE in_directory = 1")
def cdn_breakdown(t: Tables) -> DataFrame:
    org = F.col("org")
    named = org.isNotNull() & (org != "")
    return latest(t).where("in_directory = 1").agg(F.sum(flag(behind_cdn(org))).alias("behind_cdn"), F.sum(flag(named & ~behind_cdn(org))).alias("direct"), F.sum(flag(~named)).alias("unknown"))


_SIZE = "CASE " + " ".join(f"WHEN total <= {n} THEN '{s}'" for s, n in SIZES) + f" ELSE '{LAST_SIZE}' END"
_SIZE_LIST = ", ".join(f"('{s}', {i})" for i, s in enumerate([*(s for s, _ in SIZES), LAST_SIZE]))


@query("q63_user_distribution", f"WITH d(range, sort_key) AS (VALUES {_SIZE_LIST}), c AS (SELECT {_SIZE} AS range, count(*) AS n FROM {_LATEST} WHERE total IS NOT NULL GROUP BY 1) SELECT range, sort_key, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (range)")
def user_distribution(t: Tables) -> DataFrame:
    """Every class is there, with 0 where no host falls into it."""
    labels = [*(s for s, _ in SIZES), LAST_SIZE]
    classes = t.spark.createDataFrame(list(zip(labels, range(len(labels)), strict=True)), "range string, sort_key int")
    by = latest(t).where("total is not null").groupBy(size_bucket(F.col("total")).alias("range")).agg(F.count("*").alias("n"))
    return zero_fill(by, classes, ["range"], ["n"])


@query(
    "q64_concentration",
    f"WITH h AS (SELECT host, total, row_number() OVER (ORDER BY total DESC, host) AS k, sum(total) OVER () AS s FROM {_LATEST} WHERE total > 0) SELECT {r.pct('sum(CASE WHEN k <= 1 THEN total ELSE 0 END)', 'max(s)')} AS top1_pct, {r.pct('sum(CASE WHEN k <= 5 THEN total ELSE 0 END)', 'max(s)')} AS top5_pct, {r.pct('sum(CASE WHEN k <= 10 THEN total ELSE 0 END)', 'max(s)')} AS top10_pct, count(*) AS hosts FROM h",
)
def concentration(t: Tables) -> DataFrame:
    """Shares of the largest hosts: only the ten largest are ordered."""
    h = latest(t).where("total > 0").select("host", "total")
    top = h.orderBy(F.desc("total"), "host").limit(10).withColumn("k", F.row_number().over(Window.orderBy(F.desc("total"), "host")))
    sums = top.agg(*(F.sum(F.when(F.col("k") <= k, F.col("total")).otherwise(0)).alias(f"s{k}") for k in (1, 5, 10)))
    return h.agg(F.sum("total").alias("s"), F.count("*").alias("hosts")).crossJoin(F.broadcast(sums)).select(*(percent(F.col(f"s{k}"), F.col("s")).alias(f"top{k}_pct") for k in (1, 5, 10)), "hosts")


def _placed(column: str) -> Column:
    if column in PLACE:
        return F.when(behind_cdn(F.col("org")), F.lit(PLACE[column])).otherwise(F.col(column)).alias(column)
    return F.when(~behind_cdn(F.col("org")), F.col(column)).alias(column)


MANUAL = (("https://hand.host.net", "Lagos", "Nigeria", 6.5, 3.4, None), ("https://hand2.host.net", "Quito", "Ecuador", -0.2, -78.5, "Uni"))


def manual(t: Tables) -> DataFrame:
    """Places entered by hand."""
    return t.spark.createDataFrame(MANUAL, "host string, city string, country string, lat double, lon double, org string")


_MANUAL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in m) + ")" for m in MANUAL) + ") m(host, city, country, lat, lon, org)"


@query(
    "q65_locations",
    f"WITH p AS (SELECT CASE WHEN {_CDN} THEN 38.0::DOUBLE ELSE lat END AS lat, CASE WHEN {_CDN} THEN -30.0::DOUBLE ELSE lon END AS lon, CASE WHEN {_CDN} THEN 'CDN / Host Unknown' ELSE city END AS city, CASE WHEN {_CDN} THEN NULL ELSE country END AS country FROM {_LATEST} WHERE lat IS NOT NULL AND lon IS NOT NULL UNION ALL SELECT lat, lon, city, country FROM {_MANUAL}) SELECT city, country, {r.rnd('avg(lat)', 4)} AS lat, {r.rnd('avg(lon)', 4)} AS lon, count(*) AS hosts FROM p GROUP BY 1, 2",
)
def locations(t: Tables) -> DataFrame:
    """Hosts behind a CDN stand at a place of their own; the others at their city, those entered by hand with them."""
    p = latest(t).where("lat is not null AND lon is not null").select(_placed("lat"), _placed("lon"), _placed("city"), _placed("country")).unionByName(manual(t).select("lat", "lon", "city", "country"))
    mean = lambda c: F.floor(F.avg(c) * 10000.0 + 0.5).cast("double") / 10000.0
    return p.groupBy("city", "country").agg(mean("lat").alias("lat"), mean("lon").alias("lon"), F.count("*").alias("hosts"))


@query(
    "q65b_locations_with_provider",
    f"SELECT host, CASE WHEN {_CDN} THEN 38.0::DOUBLE ELSE lat END AS lat, CASE WHEN {_CDN} THEN -30.0::DOUBLE ELSE lon END AS lon, CASE WHEN {_CDN} THEN 'CDN / Host Unknown' ELSE city END AS city, {_PROVIDER} AS provider FROM {_LATEST} WHERE in_directory = 1 AND (lat IS NOT NULL OR org IS NOT NULL) UNION ALL SELECT host, lat, lon, city, coalesce(org, 'Self-hosted') FROM {_MANUAL}",
)
def locations_with_provider(t: Tables) -> DataFrame:
    p = latest(t).where("in_directory = 1 AND (lat is not null OR org is not null)").select("host", _placed("lat"), _placed("lon"), _placed("city"), provider(F.col("org")).alias("provider"))
    return p.unionByName(manual(t).select("host", "lat", "lon", "city", F.coalesce("org", F.lit("Self-hosted")).alias("provider")))


@query(
    "q72_top_host_of_city",
    f"SELECT city, arg_max(host, (total, host)) AS host, max(total) AS total, count(*) AS hosts FROM {_LATEST} WHERE city IS NOT NULL GROUP BY 1",
)
def top_host_of_city(t: Tables) -> DataFrame:
    top = F.max(F.struct("total", "host"))
    return latest(t).where("city is not null").groupBy("city").agg(top["host"].alias("host"), top["total"].alias("total"), F.count("*").alias("hosts"))


@query(
    "q73_longevity_picks",
    "WITH c AS (SELECT host, min(CAST(ts AS DATE)) AS f FROM {creations} GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY f, host) AS n, count(*) OVER () AS total FROM c) SELECT CASE WHEN n = 1 THEN 'oldest' WHEN n = total THEN 'newest' ELSE 'median' END AS pick, host, f AS first_day FROM k WHERE n IN (1, total // 2 + 1, total)",
)
def longevity_picks(t: Tables) -> DataFrame:
    """Oldest, median and newest host, by numbers given in range partitions."""
    c = t.creations.groupBy("host").agg(F.min("ts").cast("date").alias("first_day"))
    k = ranked(c, [F.col("first_day"), F.col("host")], "n")
    k = k.crossJoin(F.broadcast(k.agg(F.count("*").alias("total"))))
    pick = F.when(F.col("n") == 1, "oldest").when(F.col("n") == F.col("total"), "newest").otherwise("median")
    return k.where((F.col("n") == 1) | (F.col("n") == F.floor(F.col("total") / 2) + 1) | (F.col("n") == F.col("total"))).select(pick.alias("pick"), "host", "first_day")


@query(
    "q71b_status_chart",
    f"SELECT u AS host, total, CAST(active AS BIGINT) AS active, CAST(total - active AS BIGINT) AS inactive, {r.pct('active', 'total', 1)} AS pct_active FROM (SELECT * FROM {_SNAP} {_FIRST}) ORDER BY total DESC, u LIMIT 20",
)
def status_chart(t: Tables) -> DataFrame:
    return latest_scan(t).withColumns({"inactive": F.col("total") - F.col("active"), "pct_active": percent(F.col("active"), F.col("total"), 1)}).drop("snap").orderBy(F.desc("total"), "host").limit(20)
