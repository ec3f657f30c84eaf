"""Collectors' streams with state: JSON lines as text, edges without repeats, moves against the last value of a key, and a table of what batches took.

Each function takes a stream and leaves its state in a checkpoint, so a query that is started again goes on where it was.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from starlane.functions.expr import flag
from starlane.plans.records import EVENT, parsed, uri_did
from starlane.sources.sinks import append_delta, read_merged, replace_partitions

KEYS, HOW = ["metric", "key", "day"], {"n": "add", "mask": "or"}
KIND_BITS = {"post": 1, "like": 2, "repost": 4, "follow": 8}
OTHER_BIT = 16
PROGRESS = "query string, batch long, rows long, total_ms long, write_ms long, watermark string, observed string"
MOVES = "did long, op_id long, from_host string, to_host string, ts timestamp"
#: Where state of single keys with a time to live is kept, and no batches for that time alone when a stream is read to its end.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that a streaming query takes over when it is started."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def lines(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The lines of text files in a folder as a stream of rows (line)."""
    reader = spark.readStream
    return (reader.option("maxFilesPerTrigger", files) if files else reader).text(path).withColumnRenamed("value", "line")


def records(text: DataFrame, schema: str = EVENT, name: str = "lines") -> DataFrame:
    """Lines parsed with a schema; those that do not parse are dropped, and counted for every batch in its observed metrics."""
    rows = parsed(text, schema).observe(name, F.count("*").alias("lines"), F.coalesce(F.sum(flag(F.col("broken").isNotNull())), F.lit(0)).alias("dropped"))
    return rows.where("broken is null").drop("broken").withColumn("ts", F.timestamp_micros("time_us"))


def record_folds(events: DataFrame) -> DataFrame:
    """Records that were created, folded by account and day and by kind and day: metric, key, day, n, mask."""
    kind, bit = F.col("commit.collection"), F
    for name, b in KIND_BITS.items():
        bit = bit.when(kind == name, F.lit(b))
    key = lambda name, k: F.struct(F.lit(name).alias("metric"), k.alias("key"))
    rows = events.where("commit.operation = 'create'").select(F.to_date("ts").alias("day"), bit.otherwise(F.lit(OTHER_BIT)).alias("bit"), F.explode(F.array(key("account", F.col("did")), key("kind", kind))).alias("k"))
    return rows.groupBy("k.metric", "k.key", "day").agg(F.count("*").alias("n"), F.bit_or("bit").alias("mask"))


def fold_records(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """The folds of each batch as its delta, replaced if the batch is replayed."""
    return events.writeStream.foreachBatch(lambda batch, number: append_delta(record_folds(batch), target, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, target: str) -> DataFrame:
    return read_merged(spark, target, KEYS, HOW)


def likes(events: DataFrame) -> DataFrame:
    """liker, target, ts of likes in a stream of records."""
    made = events.where("commit.operation = 'create' AND commit.collection = 'like'")
    return made.select(F.col("did").alias("liker"), uri_did(F.get_json_object("commit.record.subject", "$.uri")).alias("target"), "ts").where("target is not null")


def new_edges(edges: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """Each edge when it first comes. A repeat is known while the watermark is less than `lateness` behind what came first; then its state is dropped."""
    return edges.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def keep_edges(edges: DataFrame, target: str, checkpoint: str, lateness: str, keys: tuple[str, ...] = ("liker", "target")) -> StreamingQuery:
    """Appends new edges to a table, a partition for each batch, replaced if the batch is replayed."""
    fresh = new_edges(edges, list(keys), lateness)
    return fresh.writeStream.foreachBatch(lambda batch, number: replace_partitions(batch.withColumn("batch", F.lit(number)), target, ["batch"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_edges(spark: SparkSession, target: str, keys: tuple[str, ...] = ("liker", "target")) -> DataFrame:
    """Every edge once. State is bounded, so a repeat that came after its edge's state was dropped is in the table twice; here it is not."""
    return spark.read.parquet(target).groupBy(*keys).agg(F.min("ts").alias("ts"))


class LastHost(StatefulProcessor):
    """The last host of each account as its state, for `days` of not being seen at most (0: for ever)."""

    def __init__(self, days: int = 0):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.host = handle.getValueState("host", "host string", self.days * 86_400_000 or None)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """An account's operations of one batch, in order of time."""
        before = self.host.get()[0] if self.host.exists() else None
        for r in sorted(rows, key=lambda r: (r.ts, r.op_id)):
            if before is not None and r.host != before:
                yield Row(did=key[0], op_id=r.op_id, from_host=before, to_host=r.host, ts=r.ts)
            before = r.host
        self.host.update((before,))

    def close(self) -> None:
        pass


def moves(operations: DataFrame, days: int = 0) -> DataFrame:
    """Moves between hosts from a stream of operations (did, op_id, ts, host)."""
    return operations.groupBy("did").transformWithState(LastHost(days), MOVES, "Append", "ProcessingTime" if days else "None")


def append_moves(operations: DataFrame, target: str, checkpoint: str, days: int = 0) -> StreamingQuery:
    """Appends moves to a table; the session's settings are those that such state needs."""
    with settings(operations.sparkSession, **STATE):
        return moves(operations, days).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Keeps what every batch of the session's queries took as rows of a table, a folder for each batch, for longer than Spark remembers it.

    A batch that is run again after a failure replaces its row. Batches without a trigger of their own (idle reports) are passed over.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target, self._ended, self._change = spark, target, set(), threading.Condition()

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        p = event.progress
        took = lambda k: int(p.durationMs.get(k, 0))
        if "addBatch" not in p.durationMs:
            return
        seen = {k: r.asDict() for k, r in p.observedMetrics.items()}
        row = (str(p.id), p.batchId, p.numInputRows, took("triggerExecution"), took("addBatch"), p.eventTime.get("watermark"), json.dumps(seen))
        self.spark.createDataFrame([row], PROGRESS).coalesce(1).write.mode("overwrite").json(f"{self.target}/of={p.id}/no={p.batchId}")

    def onQueryTerminated(self, event: Any) -> None:
        with self._change:
            self._ended.add(str(event.id))
            self._change.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all reports of a query that has ended are in the table: they come after it, in a thread of their own."""
        with self._change:
            if not self._change.wait_for(lambda: str(query.id) in self._ended, seconds):
                raise TimeoutError(f"no end of query {query.id} was reported")

    def read(self) -> DataFrame:
        return self.spark.read.schema(PROGRESS).json(f"{self.target}/*/*")


@contextmanager
def watched(spark: SparkSession, target: str) -> Iterator[Progress]:
    """The session's streams are reported into a table while inside."""
    listener = Progress(spark, target)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
