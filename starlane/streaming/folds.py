"""The collectors' folds over streams. The same column logic serves batch and stream; event time is UTC.

Late events are merged into the day that they belong to, whenever they come, so the folds need no watermark: each micro-batch is
folded by itself, and the deltas are merged by key when read. A replayed batch replaces its own delta.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starlane.plans.collectors import event_bit, folds
from starlane.plans.registry import QUERIES, SQL
from starlane.sources.scratch import finished, shared_folder
from starlane.sources.sinks import append_delta, read_merged, replace_partitions

KEYS, HOW = ["metric", "key", "day"], {"n": "add", "mask": "or"}


def stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet file or a folder of them as a stream; timestamps without a zone are UTC instants, which watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    # The source takes a single file only by a pattern; this one fits nothing but the path itself.
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def fold_stream(events: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """In micro-batches, each of whose folds are appended as its delta: all that there is, or, with every ("60 seconds"), for ever at that pace."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return events.writeStream.foreachBatch(lambda batch, number: append_delta(folds(batch), target, number)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def track_until(rows: DataFrame, target: str, checkpoint: str, most: int) -> StreamingQuery:
    """Appends batches to a side table until it holds `most` rows; from then on tracking is paused and the stream goes on without it.

    Rows are counted from the files' footers; a replayed batch replaces itself.
    """
    spark = rows.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        if not there or spark.read.parquet(target).where(F.col("batch") < number).count() < most:
            replace_partitions(batch.withColumn("batch", F.lit(number)), target, ["batch"])

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latencies(query: StreamingQuery) -> list[dict[str, Any]]:
    """Batch, rows, and milliseconds in all and in writing, of the query's latest batches (Spark keeps a bounded number)."""
    ms = lambda p, k: int(p["durationMs"].get(k, 0))
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "total_ms": ms(p, "triggerExecution"), "write_ms": ms(p, "addBatch")} for p in query.recentProgress]


def latest_values(rows: DataFrame, keys: list[str], order: str, target: str, checkpoint: str) -> StreamingQuery:
    """Last write wins by key: each batch leaves its last row of each key as its delta; read_latest merges them."""
    plain = [c for c in rows.columns if c not in keys]

    def keep(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in plain if c != order))).alias("l")).select(*keys, *(f"l.{c}" for c in plain))
        replace_partitions(last.withColumn("batch", F.lit(number)), target, ["batch"])

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    deltas = spark.read.parquet(target).drop("batch")
    plain = [c for c in deltas.columns if c not in keys and c != order]
    return deltas.groupBy(*keys).agg(F.max(F.struct(order, *plain)).alias("l")).select(*keys, "l.*")


def folded(spark: SparkSession, target: str) -> DataFrame:
    return read_merged(spark, target, KEYS, HOW)


def daily_masks(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each account's bits of each day, as running state; state older than the watermark is dropped."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", lateness).groupBy(day, F.col("user_id").alias("did")).agg(F.bit_or(event_bit(F.col("event_type"))).alias("mask")).select("did", F.to_date("window.start").alias("dt"), "mask")


def _streamed_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_folder(spark)
    query = fold_stream(stream(spark, f"{sf_dir}/events.parquet"), f"{target}/out", f"{target}/state")
    query.awaitTermination()
    return folded(spark, f"{target}/out")


def _streamed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_folder(spark)
    rows = stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), "value")
    latest_values(rows, ["user_id", "event_type"], "at", f"{target}/out", f"{target}/state").awaitTermination()
    found = read_latest(spark, f"{target}/out", ["user_id", "event_type"], "at")
    return found.select("user_id", "event_type", "at.event_id", "value")


def register() -> None:
    """The streamed folds must give what the batch folds give."""
    QUERIES["sm18_streamed_latest"] = lambda spark, sf_dir: finished(spark, lambda: _streamed_latest(spark, sf_dir))
    SQL["sm18_streamed_latest"] = "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2"
    QUERIES["sm03_streamed_folds"] = lambda spark, sf_dir: finished(spark, lambda: _streamed_folds(spark, sf_dir))
    SQL["sm03_streamed_folds"] = SQL["q80_daily_folds"]
