"""Smaller operators of the survey, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.functions.expr import core_host, flag, hostname, round_to, uniform
from starlane.operators.archetypes import latest_per_key
from starlane.operators.graph import percentiles
from starlane.plans import registry as r
from starlane.plans.records import first_name, sql_first_name
from starlane.plans.registry import query
from starlane.sources.bindings import Tables

HIDDEN = 60
RATE = 0.25

_PAIR = "least(from_host, to_host) AS a, greatest(from_host, to_host) AS b"
_CORE = ["from_host LIKE '%.core.network'", "to_host LIKE '%.core.network'"]


@query("ag32_host_pairs", f"SELECT {_PAIR}, count(*) AS n FROM {{migrations}} GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 15")
def host_pairs(t: Tables) -> DataFrame:
    """The fifteen busiest pairs of hosts, whichever way accounts move between them."""
    by = t.migrations.groupBy(F.least("from_host", "to_host").alias("a"), F.greatest("from_host", "to_host").alias("b")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "a", "b").limit(15)


@query(
    "flt30_federation",
    f"SELECT year(ts) AS year, CASE WHEN {_CORE[0]} AND {_CORE[1]} THEN 'core to core' WHEN {_CORE[0]} THEN 'core to indie' WHEN {_CORE[1]} THEN 'indie to core' ELSE 'indie to indie' END AS category, count(*) AS total, {r.long_sum(f'NOT ({_CORE[0]} AND {_CORE[1]})')} AS crossing FROM {{migrations}} GROUP BY 1, 2",
)
def federation(t: Tables) -> DataFrame:
    """Moves by whether either end is the platform's own."""
    a, b = core_host(F.col("from_host")), core_host(F.col("to_host"))
    kind = F.when(a & b, "core to core").when(a, "core to indie").when(b, "indie to core").otherwise("indie to indie")
    return t.migrations.groupBy(F.year("ts").cast("long").alias("year"), kind.alias("category")).agg(F.count("*").alias("total"), F.sum(flag(~(a & b))).alias("crossing"))


@query("flt37_small_counts_hidden", f"WITH h AS (SELECT host, count(*) AS n FROM {{accounts}} GROUP BY 1) SELECT host, n FROM h WHERE n >= {HIDDEN} UNION ALL SELECT '(hidden)', count(*) FROM h WHERE n < {HIDDEN}")
def small_counts_hidden(t: Tables) -> DataFrame:
    """Hosts with few accounts are not named; how many there are is told."""
    h = t.accounts.groupBy("host").agg(F.count("*").alias("n"))
    return h.where(F.col("n") >= HIDDEN).unionByName(h.where(F.col("n") < HIDDEN).agg(F.count("*").alias("n")).select(F.lit("(hidden)").alias("host"), "n"))


@query("flt22_display_names", "SELECT DISTINCT host, split_part(regexp_replace(host, '^https?://', ''), '.', -2) || '.' || split_part(regexp_replace(host, '^https?://', ''), '.', -1) AS label FROM {accounts}")
def display_names(t: Tables) -> DataFrame:
    """A host's last two labels."""
    labels = F.split(hostname(F.col("host")), r"\.")
    return t.accounts.select("host", F.array_join(F.slice(labels, -2, 2), ".").alias("label")).distinct()


@query(
    "flt32_creations_in_json",
    """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '{"prev":null}' WHEN 1 THEN '{"type":"update"}' WHEN 2 THEN '{"type":"create","prev":"x"}' ELSE '{"prev":"y"}' END AS op FROM {orders})
    SELECT op, json_extract_string(op, '$.type') IS NOT DISTINCT FROM 'create' OR (list_contains(json_keys(op), 'prev') AND json_extract_string(op, '$.prev') IS NULL) AS creates, count(*) AS n FROM o GROUP BY 1, 2""",
)
def creations_in_json(t: Tables) -> DataFrame:
    """Only an explicit null counts as no predecessor; a missing field does not."""
    case = F.pmod("o_orderkey", F.lit(4))
    op = F.when(case == 0, '{"prev":null}').when(case == 1, '{"type":"update"}').when(case == 2, '{"type":"create","prev":"x"}').otherwise('{"prev":"y"}')
    ops = t.orders.select(op.alias("op"))
    explicit = F.array_contains(F.json_object_keys("op"), "prev") & F.get_json_object("op", "$.prev").isNull()
    return ops.groupBy("op", (F.get_json_object("op", "$.type").eqNullSafe("create") | explicit).alias("creates")).agg(F.count("*").alias("n"))


@query(
    "flt33_handles",
    "WITH o AS (SELECT o_custkey AS did, CASE WHEN o_orderkey % 30 = 1 THEN ['at://' || repeat('y', 250) || o_custkey, 'at://b'] WHEN o_orderkey % 3 = 0 THEN ['dns:x', 'at://User' || o_custkey || '.Example'] WHEN o_orderkey % 3 = 1 THEN ['at:// A' || o_orderkey || ' ', 'at://b'] ELSE ['none', 'at:// '] END AS aliases, CASE WHEN o_orderkey % 2 = 0 THEN ' Old' || o_custkey END AS old FROM {orders}), "
    f"h AS (SELECT did, {sql_first_name('aliases', 'old')} AS handle FROM o) SELECT handle, count(*) AS n, count(DISTINCT did) AS accounts FROM h WHERE handle IS NOT NULL GROUP BY 1",
)
def handles(t: Tables) -> DataFrame:
    """The first alias of the right scheme that is a name, trimmed, lower-cased and cut, else the old field."""
    key, custkey = F.pmod("o_orderkey", F.lit(3)), F.col("o_custkey").cast("string")
    long = F.array(F.concat(F.lit("at://" + "y" * 250), custkey), F.lit("at://b"))
    aliases = F.when(F.pmod("o_orderkey", F.lit(30)) == 1, long).when(key == 0, F.array(F.lit("dns:x"), F.concat(F.lit("at://User"), custkey, F.lit(".Example")))).when(key == 1, F.array(F.concat(F.lit("at:// A"), "o_orderkey", F.lit(" ")), F.lit("at://b"))).otherwise(F.array(F.lit("none"), F.lit("at:// ")))
    old = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.concat(F.lit(" Old"), custkey))
    rows = t.orders.select(F.col("o_custkey").alias("did"), first_name(aliases, old).alias("handle")).where("handle is not null")
    return rows.groupBy("handle").agg(F.count("*").alias("n"), F.count_distinct("did").alias("accounts"))


@query("flt36_sampled_negatives", f"SELECT node, bad FROM {{node_labels}} WHERE bad OR ('0x' || substr(md5('42:' || node), 1, 8))::BIGINT / 4294967296.0::DOUBLE < {RATE}")
def sampled_negatives(t: Tables) -> DataFrame:
    """A sampling operator: all positives, a share of the rest by a hash of the id."""
    return t.node_labels.where(F.col("bad") | (uniform(F.col("node")) < RATE)).select("node", "bad")


@query("ag45_value_percentiles", f"SELECT event_type, {r.rnd('quantile_cont(value, 0.5)', 4)} AS p50, {r.rnd('quantile_cont(value, 0.95)', 4)} AS p95, count(*) AS n FROM {{events}} GROUP BY 1")
def value_percentiles(t: Tables) -> DataFrame:
    """Exact percentiles with interpolation, found by running counts in range partitions."""
    p = lambda q: round_to(F.col(f"q{round(q * 100)}"), 4).alias(f"p{round(q * 100)}")
    return percentiles(t.events, "event_type", "value", (0.5, 0.95)).select("event_type", p(0.5), p(0.95), "n")


@query("jn26_hosts_by_precedence", "WITH u AS (SELECT did, host, 1 AS p FROM {current_host} UNION ALL SELECT did, host, 2 FROM {accounts}) SELECT did, host, p AS source FROM u QUALIFY row_number() OVER (PARTITION BY did ORDER BY p) = 1")
def hosts_by_precedence(t: Tables) -> DataFrame:
    """What the log says, else what the account table says."""
    u = t.current_host.select("did", "host", F.lit(1).alias("source")).unionByName(t.accounts.select("did", "host", F.lit(2).alias("source")))
    return latest_per_key(u, ["did"], [F.col("source")])


@query("jn27_left_to_scan", "WITH done AS (SELECT did FROM {repo_status}), seen AS (SELECT DISTINCT did FROM {activity} WHERE dt >= DATE '2024-01-23') SELECT a.did, host FROM {accounts} a WHERE a.did NOT IN (SELECT did FROM done) AND a.did IN (SELECT did FROM seen)")
def left_to_scan(t: Tables) -> DataFrame:
    """A worklist: seen lately and not done."""
    seen = t.activity.where(F.col("dt") >= F.lit("2024-01-23").cast("date")).select("did")
    return t.accounts.join(t.repo_status, "did", "left_anti").join(seen, "did", "left_semi").select("did", "host")
