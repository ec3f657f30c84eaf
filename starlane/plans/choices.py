"""Queries over lists, thresholds and orders that a caller chooses, and over what several sources say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlane.functions.expr import bare, core_host, flag, percent, round_to, week
from starlane.operators.archetypes import null_aware_anti
from starlane.operators.graph import node_ids
from starlane.plans import registry as r
from starlane.plans.cubes import lang_summary
from starlane.plans.graphs import _SCORE, scored
from starlane.plans.records import _EV, address, events
from starlane.plans.registry import query
from starlane.sources.bindings import Tables
from starlane.sources.scratch import shared_folder

CORE = "core.network"
#: Hosts that changed their name, old: new.
RENAMED = {"https://nation-3.host.net": "https://nation-4.host.net"}
# Eras by first and last month, as strings; day 99 is after every day of a month.
ERAS = (("Pre-2023", "0000-00", "2022-12-99"), ("2023", "2023-01", "2023-12-99"), ("2024 pre-Nov", "2024-01", "2024-10-99"), ("2024 Nov–Dec", "2024-11", "2024-12-99"), ("2025 H1", "2025-01", "2025-06-99"), ("2025 H2", "2025-07", "2025-12-99"), ("2026+", "2026-01", "9999-99-99"))
LEAST_SCORE = 40.0
LISTED = ["https://nation-1.host.net", "https://nation-2.host.net", "https://nation-0.core.network", "https://not-there.net"]
TRAIT, PARTS, SHOWN = "en", 5, 15
ADMITTED = ["spam", "impersonation"]
SERVICE = "did:service"
GAMMA, WEIGHT = 2.0, 3.0


def renamed(host: Column) -> Column:
    """The platform's hosts under one name, and an operator's old name as its new one."""
    out = F.when(core_host(host), F.lit(CORE))
    for old, new in RENAMED.items():
        out = out.when(bare(host) == old, F.lit(new))
    return out.otherwise(host)


@query("flt04_renamed_hosts", f"SELECT CASE WHEN host LIKE '%.core.network' THEN '{CORE}' " + " ".join(f"WHEN host = '{a}' THEN '{b}'" for a, b in RENAMED.items()) + " ELSE host END AS host, CAST(date_trunc('week', created) AS DATE) AS week, count(*) AS n FROM {accounts} GROUP BY 1, 2")
def renamed_hosts(t: Tables) -> DataFrame:
    return t.accounts.groupBy(renamed(F.col("host")).alias("host"), week(F.col("created")).alias("week")).agg(F.count("*").alias("n"))


#: The platform's second name, as hosts have it that are not under its own suffix.
SECOND = "https://5-low.host.net"


def own_host(host: Column, second: bool = False) -> Column:
    """Run by the platform: by its suffix, or, in the wider form, also under its second name."""
    return core_host(host) | (bare(host) == SECOND) if second else core_host(host)


_OWN = ("{0} LIKE '%.core.network'", f"({{0}} LIKE '%.core.network' OR {{0}} = '{SECOND}')")


def _inside(own: str) -> str:
    return f"NOT ({own.format('from_host')} AND {own.format('to_host')})"


@query("flt08_moves_outside", f"SELECT year(ts) AS year, count(*) AS moves, {r.long_sum(_inside(_OWN[0]))} AS outside, {r.long_sum(_inside(_OWN[1]))} AS outside_wider FROM {{migrations}} GROUP BY 1")
def moves_outside(t: Tables) -> DataFrame:
    """Moves but for those from one of the platform's hosts to another, by either form of what is the platform's."""
    inside = lambda second: own_host(F.col("from_host"), second) & own_host(F.col("to_host"), second)
    return t.migrations.groupBy(F.year("ts").cast("long").alias("year")).agg(F.count("*").alias("moves"), F.sum(flag(~inside(False))).alias("outside"), F.sum(flag(~inside(True))).alias("outside_wider"))


def era(first_week: Column) -> Column:
    out = F.when(first_week.between(*ERAS[0][1:]), F.lit(ERAS[0][0]))
    for label, low, high in ERAS[1:]:
        out = out.when(first_week.between(low, high), F.lit(label))
    return out


@query("flt14_eras", "WITH w AS (SELECT strftime(created, '%Y-%m-%d') AS d FROM {accounts}) SELECT CASE " + " ".join(f"WHEN d >= '{a}' AND d <= '{b}' THEN '{n}'" for n, a, b in ERAS) + " END AS era, count(*) AS n, min(d) AS first, max(d) AS last FROM w GROUP BY 1")
def eras(t: Tables) -> DataFrame:
    """Accounts by era; dates are compared as strings, so that a whole month lies before its day 99."""
    d = F.date_format("created", "yyyy-MM-dd")
    return t.accounts.groupBy(era(d).alias("era")).agg(F.count("*").alias("n"), F.min(d).alias("first"), F.max(d).alias("last"))


@query("flt39_score_threshold", f"SELECT event_type, count(*) AS n, {r.long_sum(f"coalesce(TRY_CAST(json_extract(props, '$.k') AS DOUBLE), 0) >= {LEAST_SCORE}")} AS kept FROM {{events}} GROUP BY 1")
def score_threshold(t: Tables) -> DataFrame:
    """Scores come as a map; one that is missing counts as 0."""
    scores = F.from_json("props", "map<string,double>")
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(flag(F.coalesce(F.try_element_at(scores, F.lit("k")), F.lit(0.0)) >= LEAST_SCORE)).alias("kept"))


@query("jn21_listed_hosts", "SELECT did, host FROM {accounts} WHERE host IN (SELECT unnest([" + ", ".join(f"'{h}'" for h in LISTED) + "]))")
def listed_hosts(t: Tables) -> DataFrame:
    """Accounts on hosts of a list that the caller gives; a list in the caller's memory may be broadcast."""
    listed = t.spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("host"))
    return t.accounts.join(F.broadcast(listed), "host", "left_semi").select("did", "host")


@query(
    "jn06_not_in",
    "SELECT 'as it is' AS list, count(*) AS n FROM {nation} WHERE n_name NOT IN (SELECT country FROM {snapshots} WHERE is_online = 0) UNION ALL SELECT 'without nulls', count(*) FROM {nation} WHERE n_name NOT IN (SELECT country FROM {snapshots} WHERE is_online = 0 AND country IS NOT NULL)",
)
def not_in(t: Tables) -> DataFrame:
    """Nations without a scan that found its host away. NOT IN: a list that holds a null leaves no row."""
    places, names = t.snapshots.where("is_online = 0").select(F.col("country").alias("n_name")), t.nation.select("n_name")
    tally = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("list"), "n")
    return tally(null_aware_anti(names, places, "n_name"), "as it is").unionByName(tally(null_aware_anti(names, places.where("n_name is not null"), "n_name"), "without nulls"))


@query("ag43_distinct_places", "SELECT country, count(DISTINCT rtrim(url, '/')) AS hosts, count(DISTINCT city || '|' || country) AS places FROM {snapshots} WHERE is_partial = 0 GROUP BY 1")
def distinct_places(t: Tables) -> DataFrame:
    """Sizes of sets: hosts and named places; a scan without a place adds none."""
    full = t.snapshots.where("is_partial = 0")
    return full.groupBy("country").agg(F.count_distinct(bare(F.col("url"))).alias("hosts"), F.count_distinct(F.concat("city", F.lit("|"), "country")).alias("places"))


def ordered(df: DataFrame, by: str, down: bool, key: str) -> DataFrame:
    """df in the order that a user picks; nulls count as 0, ties go by key."""
    by_ = F.coalesce(F.col(by), F.lit(0))
    return df.orderBy(by_.desc() if down else by_.asc(), key)


_HOST_LANGS = "(SELECT host, split_part(lang, '-', 1) AS lang, count(DISTINCT l.did) AS dids FROM {did_langs} l JOIN {accounts} a ON l.did = a.did WHERE lang <> '' GROUP BY 1, 2 HAVING count(DISTINCT l.did) >= 2)"


@query(
    "ag28_host_composition",
    f"""WITH s AS {_HOST_LANGS}, k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY dids DESC, lang) AS i FROM s)
    SELECT host, max(CASE WHEN lang = '{TRAIT}' THEN dids END) AS trait, CAST(sum(dids) AS BIGINT) AS total, {r.pct(f"max(CASE WHEN lang = '{TRAIT}' THEN dids END)", 'sum(dids)', 1)} AS pct, string_agg(lang || ' ' || dids, ', ' ORDER BY i) FILTER (WHERE i <= {PARTS}) AS composition
    FROM k GROUP BY 1 HAVING max(CASE WHEN lang = '{TRAIT}' THEN dids END) IS NOT NULL ORDER BY total DESC, pct DESC, host LIMIT {SHOWN}""",
)
def host_composition(t: Tables) -> DataFrame:
    """Hosts that have speakers of a language: its share, and their five largest languages; the fifteen largest hosts. Languages are few, so a host's list is short."""
    trait = F.max(F.when(F.col("lang") == TRAIT, F.col("dids")))
    parts = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("dids")).alias("less"), "lang"))), 1, PARTS)
    shown = F.array_join(F.transform(parts, lambda p: F.concat(p["lang"], F.lit(" "), (-p["less"]).cast("string"))), ", ")
    by = lang_summary(t).groupBy("host").agg(trait.alias("trait"), F.sum("dids").alias("total"), percent(trait, F.sum("dids"), 1).alias("pct"), shown.alias("composition")).where("trait is not null")
    return by.orderBy(F.desc("total"), F.desc("pct"), "host").limit(SHOWN)


@query(
    "so08_chosen_order",
    f"""WITH s AS {_HOST_LANGS}, k AS (SELECT host, coalesce(max(CASE WHEN lang = '{TRAIT}' THEN dids END), 0) AS trait, CAST(sum(dids) AS BIGINT) AS total FROM s GROUP BY 1)
    SELECT 'total down' AS chosen, * FROM (SELECT * FROM k ORDER BY total DESC, host LIMIT 5) UNION ALL SELECT 'trait up', * FROM (SELECT * FROM k ORDER BY trait, host LIMIT 5)""",
)
def chosen_order(t: Tables) -> DataFrame:
    """The first five in two orders of the many that a user can pick."""
    rows = lang_summary(t).groupBy("host").agg(F.coalesce(F.max(F.when(F.col("lang") == TRAIT, F.col("dids"))), F.lit(0)).alias("trait"), F.sum("dids").alias("total"))
    first = lambda by, down, name: ordered(rows, by, down, "host").limit(5).select(F.lit(name).alias("chosen"), "host", "trait", "total")
    return first("total", True, "total down").unionByName(first("trait", False, "trait up"))


_RUNS = "(SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS completed, CASE o_orderpriority WHEN '1-URGENT' THEN 'full-scan' WHEN '2-HIGH' THEN 'scan-geo' WHEN '3-MEDIUM' THEN 'directory' ELSE 'other' END AS source FROM {orders} WHERE o_orderstatus = 'F')"
_LAST = "arg_max(completed, id) FILTER (WHERE source LIKE '%{}%')"


@query("q68_latest_runs", f"SELECT max(id) AS dir_id, arg_max(completed, id) AS dir_at, coalesce(max(id) FILTER (WHERE source LIKE '%geo%'), max(id) FILTER (WHERE source LIKE '%full%')) AS geo_id, coalesce({_LAST.format('geo')}, {_LAST.format('full')}) AS geo_at, coalesce(max(id) FILTER (WHERE source LIKE '%users%'), max(id) FILTER (WHERE source LIKE '%full%')) AS users_id, coalesce({_LAST.format('users')}, {_LAST.format('full')}) AS users_at FROM {_RUNS}")
def latest_runs(t: Tables) -> DataFrame:
    """The latest completed run of any kind, of places and of users; where no run of its kind has completed, the latest full one. One aggregation."""
    p = F.col("o_orderpriority")
    source = F.when(p == "1-URGENT", "full-scan").when(p == "2-HIGH", "scan-geo").when(p == "3-MEDIUM", "directory").otherwise("other")
    runs = t.orders.where("o_orderstatus = 'F'").select(F.struct(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("at")).alias("run"), source.alias("source"))
    last = lambda part: F.max(F.when(F.col("source").contains(part), F.col("run")))
    found = runs.agg(F.max("run").alias("dir"), F.coalesce(last("geo"), last("full")).alias("geo"), F.coalesce(last("users"), last("full")).alias("users"))
    return found.select(*(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("dir", "geo", "users") for c in ("id", "at")))


@query(
    "src06_places_by_ip",
    "WITH g AS (SELECT ip, arg_max(country, (snap, url)) AS country, arg_max(city, (snap, url)) AS city FROM {snapshots} WHERE ip IS NOT NULL AND country IS NOT NULL GROUP BY 1), h AS (SELECT rtrim(url, '/') AS host, arg_max(coalesce(ip, ''), (snap, url)) AS ip FROM {snapshots} GROUP BY 1) SELECT host, nullif(h.ip, '') AS ip, country, city FROM h LEFT JOIN g ON h.ip = g.ip",
)
def places_by_ip(t: Tables) -> DataFrame:
    """Each address is looked up once, and what is found goes to all hosts that have it; a host without one keeps its row, with nulls."""
    at = F.struct("snap", "url")
    geo = t.snapshots.where("ip is not null and country is not null").groupBy("ip").agg(F.max(F.struct(at.alias("at"), "country", "city")).alias("g")).select("ip", "g.country", "g.city")
    hosts = t.snapshots.groupBy(bare(F.col("url")).alias("host")).agg(F.max(F.struct(at.alias("at"), "ip")).alias("h")).select("host", "h.ip")
    return hosts.join(geo, "ip", "left").select("host", "ip", "country", "city")


@query(
    "jn16_reply_graph",
    f"""WITH p AS (SELECT did, rkey, json_extract_string(record, '$.reply.parent.uri') AS parent FROM {_EV} WHERE operation = 'create' AND collection = 'post'),
    n AS (SELECT did, row_number() OVER (ORDER BY did) - 1 AS idx FROM (SELECT DISTINCT did FROM p))
    SELECT DISTINCT a.idx AS src, b.idx AS dst FROM p JOIN p q ON p.parent = 'at://' || q.did || '/post/' || q.rkey JOIN n a ON p.did = a.did JOIN n b ON q.did = b.did WHERE p.did <> q.did""",
)
def reply_graph(t: Tables) -> DataFrame:
    """Who replies to whom: replies meet the record that they name, and both authors get their numbers. Records and pairs are made distinct before each join."""
    posts = events(t).where("broken is null AND commit.operation = 'create' AND commit.collection = 'post'").select("did", "commit.rkey", F.col("commit.record.reply.parent.uri").alias("parent"))
    replies = posts.where("parent is not null").select(F.col("did").alias("from"), F.col("parent").alias("uri")).distinct()
    records = posts.select(F.col("did").alias("to"), address(F.col("did"), F.lit("post"), F.col("rkey")).alias("uri")).distinct()
    pairs = replies.join(records, "uri").where(F.col("from") != F.col("to")).select("from", "to").distinct()
    ids = node_ids(posts, "did")
    numbered = pairs.join(ids.select(F.col("did").alias("from"), F.col("idx").alias("src")), "from").join(ids.select(F.col("did").alias("to"), F.col("idx").alias("dst")), "to")
    return numbered.select("src", "dst")


_GIVEN = f"(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'at://did:' ELSE 'did:' END || doc_id AS uri, CASE WHEN doc_id % 13 = 1 THEN '!warn' WHEN toxic = 1 THEN 'spam' WHEN quality = 0 THEN 'impersonation' ELSE 'benign' END AS val, doc_id % 11 = 3 AS neg, CASE WHEN doc_id % 17 = 5 THEN 'did:other' ELSE '{SERVICE}' END AS src FROM {{labels}})"


@query("flt34_labels_admitted", f"SELECT val AS label, count(*) AS n, min(uri) AS first FROM {_GIVEN} WHERE starts_with(uri, 'did:') AND NOT starts_with(val, '!') AND NOT neg AND src = '{SERVICE}' AND val IN ({', '.join(repr(a) for a in ADMITTED)}) GROUP BY 1")
def labels_admitted(t: Tables) -> DataFrame:
    """Labels of accounts only, not taken back, no system labels, from the right service, in the list."""
    i, v = F.col("doc_id"), F.col("val")
    given = t.labels.select(
        i, F.concat(F.when(F.pmod(i, F.lit(7)) == 0, "at://did:").otherwise("did:"), i.cast("string")).alias("uri"),
        F.when(F.pmod(i, F.lit(13)) == 1, "!warn").when(F.col("toxic") == 1, "spam").when(F.col("quality") == 0, "impersonation").otherwise("benign").alias("val"),
        (F.pmod(i, F.lit(11)) == 3).alias("neg"), F.when(F.pmod(i, F.lit(17)) == 5, "did:other").otherwise(SERVICE).alias("src"),
    )
    rows = given.where(F.col("uri").startswith("did:") & ~v.startswith("!") & ~F.col("neg") & (F.col("src") == SERVICE) & v.isin(ADMITTED))
    return rows.groupBy(v.alias("label")).agg(F.count("*").alias("n"), F.min("uri").alias("first"))


def focal_loss(score: Column, hit: Column, gamma: float, weight: float) -> Column:
    """Cross entropy with a weight for hits, easy rows counted less by gamma (0: not less)."""
    right = F.when(hit, score).otherwise(1.0 - score)
    return F.when(hit, F.lit(weight)).otherwise(1.0) * -F.ln(right) * F.pow(1.0 - right, F.lit(gamma))


@query(
    "gm14_focal_loss",
    f"""WITH s AS (SELECT v.node, least(greatest({_SCORE}, 1e-6::DOUBLE), 1.0::DOUBLE - 1e-6::DOUBLE) AS p, coalesce(bad, false) AS hit FROM {{vectors}} v LEFT JOIN {{node_labels}} l ON v.node = l.node), x AS (SELECT CASE WHEN hit THEN p ELSE 1.0::DOUBLE - p END AS t, CASE WHEN hit THEN {WEIGHT}::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s)
    SELECT {r.rnd('avg(w * -ln(t))', 4)} AS weighted, {r.rnd(f'avg(w * -ln(t) * pow(1.0::DOUBLE - t, {GAMMA}::DOUBLE))', 4)} AS focal, count(*) AS n FROM x""",
)
def focal(t: Tables) -> DataFrame:
    """Mean losses of the linear score, weighted and focal; scores keep a millionth off 0 and 1."""
    p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1.0 - 1e-6))
    mean = lambda gamma: round_to(F.avg(focal_loss(p, F.col("hit"), gamma, WEIGHT)), 4)
    return scored(t).agg(mean(0.0).alias("weighted"), mean(GAMMA).alias("focal"), F.count("*").alias("n"))


@query("snk21_saved_vectors", f"SELECT cluster, count(*) AS n, {r.rnd('avg(embedding[1]::DOUBLE)', 4)} AS mean_first, max(len(embedding)) AS width FROM {{vectors}} GROUP BY 1")
def saved_vectors(t: Tables) -> DataFrame:
    """Embeddings as an artefact: single-precision arrays in Parquet, in the order of their ids, read back."""
    path = f"{shared_folder(t.spark)}/vectors"
    t.vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).repartitionByRange("node").sortWithinPartitions("node").write.parquet(path)
    v = t.spark.read.parquet(path)
    return v.groupBy("cluster").agg(F.count("*").alias("n"), round_to(F.avg(F.get("embedding", 0).cast("double")), 4).alias("mean_first"), F.max(F.size("embedding")).cast("long").alias("width"))


@query("ag29_top_host_of_place", "WITH s AS (SELECT country, city, CASE WHEN rtrim(url, '/') LIKE '%.core.network' THEN 'core.network' ELSE regexp_replace(rtrim(url, '/'), '^https?://', '') END AS host, sum(total) AS n FROM {snapshots} WHERE is_partial = 0 AND city IS NOT NULL GROUP BY 1, 2, 3) SELECT country, city, host, CAST(n AS BIGINT) AS n FROM s QUALIFY row_number() OVER (PARTITION BY country, city ORDER BY n DESC, host) = 1")
def top_host_of_place(t: Tables) -> DataFrame:
    """Each place's largest host, the platform's as one; the first by name of equal ones. Two aggregations, no window."""
    name = F.when(core_host(F.col("url")), F.lit(CORE)).otherwise(F.regexp_replace(bare(F.col("url")), "^https?://", ""))
    by = t.snapshots.where("is_partial = 0 AND city is not null").groupBy("country", "city", name.alias("host")).agg(F.sum("total").alias("n"))
    return by.groupBy("country", "city").agg(F.min(F.struct((-F.col("n")).alias("less"), "host")).alias("m")).select("country", "city", "m.host", (-F.col("m.less")).alias("n"))
