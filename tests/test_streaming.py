"""Streams must give what batches give, replay or not."""

import tempfile

import pytest

from starlane.plans.collectors import folds
from starlane.sources import sinks
from starlane.sources.bindings import Tables
from starlane.streaming import folds as streaming


@pytest.fixture
def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_folds_in_many_batches(spark, sf_dir, folder):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(4).write.parquet(f"{folder}/in")
    streaming.fold_stream(streaming.stream(spark, f"{folder}/in", files=1), f"{folder}/out", f"{folder}/state").awaitTermination()
    order = ["metric", "key", "day", "n", "mask"]
    want = values(folds(events).select(*order))
    assert values(streaming.folded(spark, f"{folder}/out").select(*order)) == want
    assert spark.read.parquet(f"{folder}/out").select("batch").distinct().count() == 4


def test_a_replayed_batch_counts_once(spark, folder):
    delta = spark.createDataFrame([("a", 2, 1)], "k string, n long, mask int")
    for _ in range(2):
        sinks.append_delta(delta, f"{folder}/d", 0)
    sinks.append_delta(delta, f"{folder}/d", 1)
    assert values(sinks.read_merged(spark, f"{folder}/d", ["k"], {"n": "add", "mask": "or"})) == [("a", 4, 1)]


def test_masks_as_running_state(spark, sf_dir, folder):
    t = Tables(spark, sf_dir)
    query = streaming.daily_masks(streaming.stream(spark, f"{sf_dir}/events.parquet")).writeStream.format("memory").queryName("masks").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    assert values(spark.table("masks").select("did", "dt", "mask")) == values(t.activity.select("did", "dt", "mask"))


def test_upsert_touches_its_partitions_only(spark, folder):
    first = spark.createDataFrame([("a", 1, 5), ("b", 2, 7)], "k string, day int, n long")
    sinks.replace_partitions(first, f"{folder}/t", ["day"])
    delta = spark.createDataFrame([("a", 1, 9), ("c", 1, 2)], "k string, day int, n long")
    for _ in range(2):
        sinks.upsert(spark, f"{folder}/t", delta, ["k", "day"], {"n": "last"}, "day")
    assert values(spark.read.parquet(f"{folder}/t").select("k", "day", "n")) == [("a", 1, 9), ("b", 2, 7), ("c", 1, 2)]
    with pytest.raises(ValueError, match="append_delta"):
        sinks.upsert(spark, f"{folder}/t", delta, ["k", "day"], {"n": "add"}, "day")
    sinks.report(first, f"{folder}/csv")
    assert spark.read.csv(f"{folder}/csv", header=True).count() == 2


def test_a_side_table_is_tracked_until_it_is_full(spark, sf_dir, folder):
    spark.range(0, 400, 1, 4).write.parquet(f"{folder}/in")
    query = streaming.track_until(streaming.stream(spark, f"{folder}/in", files=1), f"{folder}/out", f"{folder}/state", most=150)
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 200  # 100, 200, then paused
    seen = streaming.latencies(query)
    assert [b["rows"] for b in seen][:4] == [100, 100, 0, 0]  # a paused batch is not even read
    assert all(b["total_ms"] >= b["write_ms"] >= 0 for b in seen)


def test_latest_values_in_many_batches(spark, folder):
    rows = [(k, at, f"{k}{at}") for at in range(40) for k in "abc"]
    df = spark.createDataFrame(rows, "k string, at long, v string")
    df.repartition(5).write.parquet(f"{folder}/in")
    streaming.latest_values(streaming.stream(spark, f"{folder}/in", files=1), ["k"], "at", f"{folder}/out", f"{folder}/state").awaitTermination()
    assert values(streaming.read_latest(spark, f"{folder}/out", ["k"], "at")) == [(k, 39, f"{k}39") for k in "abc"]


def test_a_paced_stream_folds_and_stops(spark, sf_dir, folder):
    query = streaming.fold_stream(streaming.stream(spark, f"{sf_dir}/events.parquet"), f"{folder}/out", f"{folder}/state", every="1 second")
    query.processAllAvailable()
    query.stop()
    assert streaming.folded(spark, f"{folder}/out").count() == folds(spark.read.parquet(f"{sf_dir}/events.parquet")).count()
