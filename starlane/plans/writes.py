"""What the sinks leave behind, as queries: each writes into the shared folder, as a collector would, and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.functions.expr import core_host, flag, week
from starlane.plans import registry as r
from starlane.plans.registry import query
from starlane.sources import sinks
from starlane.sources.bindings import Tables
from starlane.sources.scratch import saved, shared_folder
from starlane.sources.tables import csv, json_lines

#: Where the second delivery begins, and the first day that retention and a rewind keep.
SINCE, KEPT, REWOUND = "1998-01-01", "2024-01-11", "2024-01-21"
#: Buckets of derived tables; a cluster would have as many as it has shuffle partitions.
BUCKETS = 8


def _handles(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Handles by account and year, in two deliveries; a quarter of them come without a name."""
    named = F.when(F.pmod("op_id", F.lit(4)) != 0, F.col("handle"))
    rows = t.oplog.select("did", F.year("ts").alias("year"), F.struct("ts", "op_id").alias("at"), named.alias("handle"))
    last = lambda df: df.groupBy("did", "year").agg(F.max_by("handle", "at").alias("handle"))
    return last(rows.where(F.pmod("at.op_id", F.lit(2)) == 0)), last(rows.where(F.pmod("at.op_id", F.lit(2)) == 1))


def _upserted(t: Tables, how: str) -> DataFrame:
    path, (old, new) = f"{shared_folder(t.spark)}/handles", _handles(t)
    sinks.replace_partitions(old, path, ["year"])
    sinks.upsert(t.spark, path, new, ["did", "year"], {"handle": how}, "year")
    return t.spark.read.parquet(path).select("did", F.col("year").cast("int").alias("year"), "handle")


_HANDLES = """WITH h AS (SELECT did, CAST(year(ts) AS INTEGER) AS year, op_id % 2 AS side, arg_max(CASE WHEN op_id % 4 <> 0 THEN handle END, (ts, op_id)) AS ignored, (array_agg(CASE WHEN op_id % 4 <> 0 THEN handle END ORDER BY ts DESC, op_id DESC))[1] AS handle FROM {oplog} GROUP BY 1, 2, 3),
    a AS (SELECT * FROM h WHERE side = 0), b AS (SELECT * FROM h WHERE side = 1)
    SELECT coalesce(a.did, b.did) AS did, coalesce(a.year, b.year) AS year, PICK AS handle FROM a FULL JOIN b ON a.did = b.did AND a.year = b.year"""


@query("snk04_last_write", _HANDLES.replace("PICK", "CASE WHEN b.did IS NOT NULL THEN b.handle ELSE a.handle END"))
def last_write(t: Tables) -> DataFrame:
    return _upserted(t, "last")


@query("snk05_first_write", _HANDLES.replace("PICK", "CASE WHEN a.did IS NOT NULL THEN a.handle ELSE b.handle END"))
def first_write(t: Tables) -> DataFrame:
    return _upserted(t, "first")


@query("snk06_null_keeps", _HANDLES.replace("PICK", "coalesce(b.handle, a.handle)"))
def null_keeps(t: Tables) -> DataFrame:
    return _upserted(t, "coalesce")


@query("snk02_replayed_deltas", "SELECT host, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM {creations} GROUP BY 1, 2")
def replayed_deltas(t: Tables) -> DataFrame:
    """Counts since a cursor are added to what was there (AG-38); a delivery that comes twice counts once."""
    path = f"{shared_folder(t.spark)}/creations"
    counts = lambda df: df.groupBy("host", week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))
    new = F.col("ts") >= F.lit(SINCE).cast("timestamp")
    for batch, rows in ((0, t.creations.where(~new)), (1, t.creations.where(new)), (1, t.creations.where(new))):
        sinks.append_delta(counts(rows), path, batch)
    return sinks.read_merged(t.spark, path, ["host", "week"], {"n": "add"})


@query("snk07_tombstones", "SELECT did, arg_max(handle, (ts, op_id)) AS handle, max((ts, op_id)).ts AS ts, CASE WHEN arg_max(nullified, (ts, op_id)) THEN max(ts) END AS deleted_at FROM (SELECT did, op_id, ts, handle, nullified FROM {oplog}) GROUP BY 1".replace("max((ts, op_id)).ts", "max(ts)"))
def tombstones(t: Tables) -> DataFrame:
    """What was deleted last keeps its row, marked; a later operation brings it back."""
    rows = t.oplog.select("did", F.struct("ts", "op_id").alias("at"), "handle", "nullified")
    kept = sinks.with_tombstones(rows, ["did"], "at", F.col("nullified"))
    path = f"{shared_folder(t.spark)}/state"
    kept.write.parquet(path)
    return t.spark.read.parquet(path).select("did", "handle", F.col("at.ts").alias("ts"), F.col("deleted_at.ts").alias("deleted_at"))


@query("snk07b_stored_tombstones", "SELECT did, arg_max(handle, (ts, op_id)) AS handle, max(ts) AS ts, CASE WHEN arg_max(nullified, (ts, op_id)) THEN max(ts) END AS deleted_at FROM {oplog} GROUP BY 1")
def stored_tombstones(t: Tables) -> DataFrame:
    """The same as state that deliveries are laid upon: the later half of the log comes first, then the earlier, and one of them twice."""
    base = f"{shared_folder(t.spark)}/state"
    rows = t.oplog.select("did", F.struct("ts", "op_id").alias("at"), "handle", "nullified")
    late = F.col("at.ts") >= F.lit(SINCE).cast("timestamp")
    for part in (rows.where(late), rows.where(~late), rows.where(late)):
        sinks.apply_changes(base, part, ["did"], "at", F.col("nullified"))
    return sinks.read_current(t.spark, base).select("did", "handle", F.col("at.ts").alias("ts"), F.col("deleted_at.ts").alias("deleted_at"))


@query("snk11_derived_tables", "WITH m AS (SELECT did, count(*) AS moves FROM {migrations} GROUP BY 1), a AS (SELECT did, count(*) AS days, bit_or(mask) AS mask FROM {activity} GROUP BY 1) SELECT moves, count(*) AS accounts, CAST(sum(days) AS BIGINT) AS days, CAST(bit_or(mask) AS INTEGER) AS mask FROM m JOIN a ON m.did = a.did GROUP BY 1")
def derived_tables(t: Tables) -> DataFrame:
    """Two derived tables in the same buckets, joined by their key without moving either; dropped when the result stands."""
    base, tag = shared_folder(t.spark), uuid.uuid4().hex
    names = f"moves_{tag}", f"days_{tag}"
    moves = sinks.derive(t.migrations.groupBy("did").agg(F.count("*").alias("moves")), names[0], f"{base}/moves", "did", BUCKETS)
    days = sinks.derive(t.activity.groupBy("did").agg(F.count("*").alias("days"), F.bit_or("mask").alias("mask")), names[1], f"{base}/days", "did", BUCKETS)
    out = saved(moves.join(days.hint("merge"), "did").groupBy("moves").agg(F.count("*").alias("accounts"), F.sum("days").alias("days"), F.bit_or("mask").alias("mask")))
    for name in names:
        t.spark.sql(f"DROP TABLE {name}")
    return out


def _days(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("dt"), "event_type").agg(F.count("*").alias("n"))


@query("snk10_pruned", f"SELECT CAST(ts AS DATE) AS dt, event_type, count(*) AS n FROM {{events}} WHERE ts >= TIMESTAMP '{KEPT} 00:00:00' GROUP BY 1, 2")
def pruned(t: Tables) -> DataFrame:
    """Partitions before a day are dropped; without a day nothing is."""
    path = f"{shared_folder(t.spark)}/days"
    sinks.replace_partitions(_days(t), path, ["dt"])
    sinks.prune(t.spark, path, "dt", None)
    sinks.prune(t.spark, path, "dt", KEPT)
    return t.spark.read.parquet(path).select("dt", "event_type", "n")


@query("sm12_rewound", "SELECT CAST(ts AS DATE) AS dt, event_type, count(*) AS n FROM {events} GROUP BY 1, 2")
def rewound(t: Tables) -> DataFrame:
    """A stream is set back half a day and read again: its counts end as if it had been read once."""
    path = f"{shared_folder(t.spark)}/days"
    sinks.replace_partitions(_days(t), path, ["dt"])
    half_day_before = F.expr(f"timestamp_ntz '{REWOUND} 00:00:00' - interval 12 hours")
    again = t.events.where(F.col("ts") >= half_day_before).groupBy(F.to_date("ts").alias("dt"), "event_type").agg(F.count("*").alias("n"))
    sinks.rewind(t.spark, path, "dt", REWOUND, again)
    return t.spark.read.parquet(path).select("dt", "event_type", "n")


@query("snk14_partitioned_json", "SELECT CAST(ts AS DATE) AS dt, CAST(hour(ts) AS INTEGER) AS hr, event_type, count(*) AS n FROM {events} GROUP BY 1, 2, 3")
def partitioned_json(t: Tables) -> DataFrame:
    path = f"{shared_folder(t.spark)}/posts"
    rows = t.events.select(F.to_date("ts").alias("dt"), F.hour("ts").alias("hr"), "event_id", "event_type")
    sinks.json_lines(rows.repartition("dt"), path, ["dt", "hr"])
    back = t.spark.read.schema("event_id long, event_type string, dt date, hr int").json(path)
    return back.groupBy("dt", "hr", "event_type").agg(F.count("*").alias("n"))


@query("snk15_variants", "SELECT 'all' AS variant, host, count(*) AS n FROM {accounts} GROUP BY 2 UNION ALL SELECT 'indie', host, count(*) FROM {accounts} WHERE host NOT LIKE '%.core.network' GROUP BY 2")
def variants(t: Tables) -> DataFrame:
    """One result in two variants, with and without the platform's own hosts, as JSON."""
    path = f"{shared_folder(t.spark)}/dashboard"
    by = t.accounts.groupBy("host").agg(F.count("*").alias("n"))
    sinks.bundle({"all": by, "indie": by.where(~core_host(F.col("host")))}, path)
    row = F.from_json("row", "host string, n long")
    return t.spark.read.schema("variant string, row string").json(path).select("variant", row["host"].alias("host"), row["n"].alias("n"))


@query("snk12_report", "SELECT host, replace(host, '//', '\"q\", //') AS quoted, count(*) AS n FROM {accounts} GROUP BY 1, 2")
def reported(t: Tables) -> DataFrame:
    """A report with quotes and commas in a field, and one of no rows, of which there is no file."""
    path = f"{shared_folder(t.spark)}/reports"
    by = t.accounts.groupBy("host", F.replace("host", F.lit("//"), F.lit('"q", //')).alias("quoted")).agg(F.count("*").alias("n"))
    sinks.report(by, f"{path}/hosts")
    sinks.report(by.where("n < 0"), f"{path}/none")
    return csv(t.spark, f"{path}/hosts").select("host", "quoted", F.col("n").cast("long").alias("n"))


@query("snk18_committed_together", f"SELECT 'creations' AS name, count(*) AS n FROM {{creations}} WHERE ts < TIMESTAMP '{SINCE} 00:00:00' UNION ALL SELECT 'migrations', count(*) FROM {{migrations}} WHERE ts < TIMESTAMP '{SINCE} 00:00:00'")
def committed_together(t: Tables) -> DataFrame:
    """Two tables of a batch are seen together or not at all: the second batch is written, but never marked."""
    base, before = f"{shared_folder(t.spark)}/log", F.col("ts") < F.lit(SINCE).cast("timestamp")
    both = {"creations": t.creations.select("did", "ts"), "migrations": t.migrations.select("did", "ts")}
    sinks.commit_batch(t.spark, base, 0, {k: v.where(before) for k, v in both.items()})
    both["creations"].where(~before).write.parquet(f"{base}/creations/batch=1")
    count = lambda name: sinks.read_committed(t.spark, base, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return count("creations").unionByName(count("migrations"))


@query("snk08_full_refresh", "SELECT host, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n FROM {creations} GROUP BY 1, 2")
def full_refresh(t: Tables) -> DataFrame:
    """A cube that is computed anew from all rows: the version that readers see is the last complete one. The first is made of a part, the second of all."""
    base = f"{shared_folder(t.spark)}/cube"
    counts = lambda df: df.groupBy("host", week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))
    sinks.refresh(counts(t.creations.where(F.col("ts") < F.lit(SINCE).cast("timestamp"))), base)
    sinks.refresh(counts(t.creations), base)
    return sinks.read_current(t.spark, base)


@query("snk20_nested_json", "SELECT cluster, node FROM {vectors}")
def nested_json(t: Tables) -> DataFrame:
    """A cluster to a line, its members in blocks inside."""
    path = f"{shared_folder(t.spark)}/clusters"
    # Blocks keep a large cluster's line short.
    blocks = t.vectors.groupBy("cluster", F.floor(F.col("node") / 1000).alias("block")).agg(F.collect_list(F.struct("node")).alias("members"))
    blocks.select(F.to_json(F.struct("cluster", F.struct("block", "members").alias("part"))).alias("value")).write.text(path)
    line = F.from_json("value", "cluster int, part struct<block:long,members:array<struct<node:long>>>")
    rows = t.spark.read.text(path).select(line.alias("l")).select("l.cluster", F.explode("l.part.members.node").alias("node"))
    return rows.withColumn("cluster", F.col("cluster").cast(dict(t.vectors.dtypes)["cluster"]))


@query(
    "src17_pool",
    f"""WITH p AS (SELECT CAST(floor(event_id / 23.0) AS BIGINT) AS uri, max(event_id) AS e FROM {{events}} WHERE event_id % 41 <> 2 GROUP BY 1), l AS (SELECT CAST(floor(event_id / 23.0) AS BIGINT) AS uri, max(event_id) AS e FROM {{events}} GROUP BY 1)
    SELECT concat('feed/', CAST(p.uri AS VARCHAR)) AS uri, p.e % 90 AS like_count FROM p JOIN l ON p.uri = l.uri WHERE p.e % 90 >= 30 AND l.e % 5 <> 0""",
)
def pool(t: Tables) -> DataFrame:
    """JSON lines and a CSV beside them: the last line of each key stands, broken lines are skipped, and only keys that the CSV's last line calls live stay."""
    path = f"{shared_folder(t.spark)}/pool"
    uri = F.concat(F.lit("feed/"), F.floor(F.col("event_id") / 23).cast("string"))
    whole = F.to_json(F.struct(uri.alias("uri"), F.pmod("event_id", F.lit(90)).alias("like_count"), F.col("event_id").alias("seq")))
    t.events.select(F.when(F.pmod("event_id", F.lit(41)) == 2, F.lit('{"uri":"feed/')).otherwise(whole).alias("value")).write.text(f"{path}/lines")
    t.events.select(uri.alias("uri"), F.when(F.pmod("event_id", F.lit(5)) != 0, "live").otherwise("gone").alias("status"), F.col("event_id").alias("seq")).write.option("header", True).csv(f"{path}/status")
    last = json_lines(t.spark, f"{path}/lines", "uri string, like_count long, seq long").groupBy("uri").agg(F.max_by("like_count", "seq").alias("like_count"))
    live = csv(t.spark, f"{path}/status").groupBy("uri").agg(F.max_by("status", F.col("seq").cast("long")).alias("status")).where("status = 'live'")
    return last.where("like_count >= 30").join(live, "uri", "left_semi").select("uri", "like_count")
