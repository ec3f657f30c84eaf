"""What collectors' streams leave behind, as queries: logs are written as files, read as streams in several batches, and the tables read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlane.operators.graph import ranked
from starlane.plans import collectors  # noqa: F401  (its SQL is checked here too)
from starlane.plans.records import _EV, _TARGET
from starlane.plans.registry import SQL, long_sum, query
from starlane.sources.bindings import Tables
from starlane.sources.scratch import delete, shared_folder
from starlane.sources.sinks import replace_partitions
from starlane.streaming import live
from starlane.streaming.folds import daily_masks, fold_stream, folded, stream, track_until

#: Files that a log is written as; the stream takes one in a batch.
FILES = 4
#: How long a repeat of an edge is known, and where the second half of the log of operations begins.
LATENESS, LATER = "60 days", "1995-01-01"

_KIND = "CASE collection " + " ".join(f"WHEN '{k}' THEN {b}" for k, b in live.KIND_BITS.items()) + f" ELSE {live.OTHER_BIT} END"


def log_files(t: Tables, path: str, times: int = 1) -> None:
    """The event log as text, in files by ranges of its sequence, `times` over."""
    for _ in range(times):
        t.event_lines.repartitionByRange(FILES, "seq").select("line").write.mode("append").text(path)


@query(
    "src01_streamed_records",
    f"""WITH e AS (SELECT did, collection, day, {_KIND} AS bit FROM {_EV} WHERE operation = 'create'), f AS (SELECT 'account' AS metric, did AS key, day, bit FROM e UNION ALL SELECT 'kind', collection, day, bit FROM e)
    SELECT metric, key, day, count(*) AS n, CAST(bit_or(bit) AS INTEGER) AS mask FROM f GROUP BY 1, 2, 3
    UNION ALL SELECT 'lines', 'all', NULL, count(*), NULL FROM {{event_lines}} UNION ALL SELECT 'lines', 'dropped', NULL, {long_sum('NOT json_valid(line)')}, NULL FROM {{event_lines}}""",
)
def streamed_records(t: Tables) -> DataFrame:
    """A log of JSON lines, streamed as text: the folds of its records, and what the batches report of lines read and dropped."""
    spark, base = t.spark, shared_folder(t.spark)
    log_files(t, f"{base}/in")
    with live.watched(spark, f"{base}/progress") as progress:
        running = live.fold_records(live.records(live.lines(spark, f"{base}/in", files=1)), f"{base}/out", f"{base}/state")
        running.awaitTermination()
        progress.wait(running)
        seen = F.from_json("observed", "lines struct<lines:long,dropped:long>")["lines"]
        counts = progress.read().select(F.explode(F.array(F.struct(F.lit("all").alias("key"), seen["lines"].alias("n")), F.struct(F.lit("dropped").alias("key"), seen["dropped"].alias("n")))).alias("c"))
    tally = counts.groupBy("c.key").agg(F.sum("c.n").alias("n")).select(F.lit("lines").alias("metric"), "key", F.lit(None).cast("date").alias("day"), "n", F.lit(None).cast("int").alias("mask"))
    return live.folded(spark, f"{base}/out").select("metric", "key", "day", "n", "mask").unionByName(tally)


@query("sm06_streamed_edges", f"SELECT DISTINCT did AS liker, target FROM (SELECT did, {_TARGET} AS target FROM {_EV} WHERE operation = 'create' AND collection = 'like') WHERE target LIKE 'did:%'")
def streamed_edges(t: Tables) -> DataFrame:
    """Edges of a stream in which every line comes twice, in other batches: each is kept once."""
    base = shared_folder(t.spark)
    log_files(t, f"{base}/in", times=2)
    live.keep_edges(live.likes(live.records(live.lines(t.spark, f"{base}/in", files=2))), f"{base}/out", f"{base}/state", LATENESS).awaitTermination()
    return live.read_edges(t.spark, f"{base}/out").select("liker", "target")


@query("sm17_streamed_moves", "SELECT did, op_id, from_host, to_host, ts FROM {migrations}")
def streamed_moves(t: Tables) -> DataFrame:
    """Moves against the last host of each account as state, over batches and a restart between them."""
    base, ops = shared_folder(t.spark), t.oplog.where(~F.col("nullified")).select("did", "op_id", "ts", "host")
    for part in (ops.where(F.col("ts") < F.lit(LATER).cast("timestamp")), ops.where(F.col("ts") >= F.lit(LATER).cast("timestamp"))):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        live.append_moves(stream(t.spark, f"{base}/in", files=1), f"{base}/out", f"{base}/state").awaitTermination()
    return t.spark.read.schema(live.MOVES).parquet(f"{base}/out")


def event_files(t: Tables, path: str) -> None:
    """Events as Parquet, in as many files of equal size as FILES says, in the order of their ids."""
    total = t.events.count()
    numbered = ranked(t.events, [F.col("event_id")], "place").withColumn("file", F.floor(F.lit(FILES) * (F.col("place") - 1) / F.lit(total)))
    for k in range(FILES):
        numbered.where(F.col("file") == k).drop("file", "place").coalesce(1).write.mode("append").parquet(path)


_FILED = f"(SELECT *, CAST(floor(({FILES} * (row_number() OVER (ORDER BY event_id) - 1)) / count(*) OVER ()) AS BIGINT) AS file FROM {{events}})"


@query("sm23_batches", f"SELECT file AS batch, count(*) AS rows, true AS timed FROM {_FILED} GROUP BY 1")
def batches(t: Tables) -> DataFrame:
    """What the batches of a stream took, from the table that the listener keeps: their rows, and whether their times are there."""
    base = shared_folder(t.spark)
    event_files(t, f"{base}/in")
    with live.watched(t.spark, f"{base}/progress") as progress:
        running = stream(t.spark, f"{base}/in", files=1).writeStream.format("noop").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        running.awaitTermination()
        progress.wait(running)
        return progress.read().select("batch", "rows", ((F.col("total_ms") >= F.col("write_ms")) & (F.col("write_ms") >= 0)).alias("timed"))


@query("sm02_streamed_masks", "SELECT did, dt, mask FROM {activity}")
def streamed_masks(t: Tables) -> DataFrame:
    """Each account's bits of each day as running state; every batch leaves the days that it has changed, and bits only ever come, so the table is their union."""
    base = shared_folder(t.spark)
    event_files(t, f"{base}/in")
    running = daily_masks(stream(t.spark, f"{base}/in", files=1), LATENESS).writeStream.outputMode("update")
    running.foreachBatch(lambda batch, number: replace_partitions(batch.withColumn("batch", F.lit(number)), f"{base}/out", ["batch"])).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("did", "dt").agg(F.bit_or("mask").alias("mask"))


@query("sm16_tracked_until_full", f"SELECT event_type, count(*) AS n, max(event_id) AS last FROM {_FILED} WHERE file < 2 GROUP BY 1")
def tracked_until_full(t: Tables) -> DataFrame:
    """A side table that takes batches until it holds two fifths of the log: with the second of four it does, and the others are read past it."""
    base = shared_folder(t.spark)
    event_files(t, f"{base}/in")
    rows = stream(t.spark, f"{base}/in", files=1).select("event_id", "event_type")
    track_until(rows, f"{base}/out", f"{base}/state", most=2 * t.events.count() // 5).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("sm11_replayed_batch", SQL["q80_daily_folds"])
def replayed_batch(t: Tables) -> DataFrame:
    """Data first, then the mark that says so: a collector that stops between the two reads its last batch again when it is started, and no sum counts twice. The mark of the last batch is taken away here."""
    base = shared_folder(t.spark)
    event_files(t, f"{base}/in")
    run = lambda: fold_stream(stream(t.spark, f"{base}/in", files=1), f"{base}/out", f"{base}/state").awaitTermination()
    run()
    delete(t.spark, f"{base}/state/commits/{FILES - 1}")
    run()
    return folded(t.spark, f"{base}/out")
