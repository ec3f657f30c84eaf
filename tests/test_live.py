"""Streams with state over batches and restarts, the table of batches, refreshes and compactions that fail half way, and what is left behind."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from starlane.plans import catalogue
from starlane.plans.records import OPERATION
from starlane.sources import scratch, sinks
from starlane.sources.bindings import Tables
from starlane.streaming import live
from starlane.streaming.folds import stream


@pytest.fixture
def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def text(spark, folder, lines):
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("append").text(folder)


def event(did, n, when="2024-01-01T00:00:00+00:00", kind="like", target="did:9"):
    us = int(dt.datetime.fromisoformat(when).timestamp() * 1e6)
    record = {"text": f"t{n}", "subject": {"uri": f"at://{target}/post/k"}}
    return json.dumps({"did": did, "time_us": us, "kind": "commit", "commit": {"operation": "create", "collection": kind, "rkey": f"k{n}", "record": record}})


def test_text_is_parsed_and_broken_lines_are_counted_by_batch(spark, folder):
    text(spark, f"{folder}/in", [event("did:1", 1), "{", event("did:1", 2, kind="post")])
    text(spark, f"{folder}/in", ["", event("did:2", 3), '{"kind":"commit"}', "nonsense"])
    with live.watched(spark, f"{folder}/progress") as progress:
        query = live.fold_records(live.records(live.lines(spark, f"{folder}/in", files=1)), f"{folder}/out", f"{folder}/state")
        query.awaitTermination()
        progress.wait(query)
        seen = {r.batch: json.loads(r.observed)["lines"] for r in progress.read().collect()}
    # An empty line and one without an account do not count as records either.
    assert sorted((x["lines"], x["dropped"]) for x in seen.values()) == [(3, 1), (4, 3)]
    day = dt.date(2024, 1, 1)
    assert values(live.folded(spark, f"{folder}/out")) == [("account", "did:1", day, 2, 3), ("account", "did:2", day, 1, 2), ("kind", "like", day, 2, 2), ("kind", "post", day, 1, 1)]


def test_other_records_have_their_schema(spark, folder):
    text(spark, f"{folder}/in", ['{"did":"did:1","cid":"c","operation":{"type":"create","service":"http://a"}}', "x"])
    rows = live.parsed(live.lines(spark, f"{folder}/in"), OPERATION).where("broken is null").select("did", "operation.service")
    rows.writeStream.format("memory").queryName("other_records").trigger(availableNow=True).start().awaitTermination()
    assert values(spark.table("other_records")) == [("did:1", "http://a")]


def test_repeated_edges_are_known_until_the_watermark_has_passed(spark, folder):
    def run():
        query = live.keep_edges(live.likes(live.records(live.lines(spark, f"{folder}/in", files=1))), f"{folder}/out", f"{folder}/state", "2 days")
        query.awaitTermination()
        return [(p["numInputRows"], p["stateOperators"][0]["numRowsTotal"]) for p in query.recentProgress if p["stateOperators"]]

    kept = lambda: spark.read.parquet(f"{folder}/out").count()
    text(spark, f"{folder}/in", [event("did:1", 1), event("did:1", 2), event("did:2", 3)])
    run()
    text(spark, f"{folder}/in", [event("did:1", 1), event("did:1", 4, when="2024-01-02T00:00:00+00:00")])
    assert run()[-1][1] == 2 and kept() == 2  # after a restart, repeats are still known
    text(spark, f"{folder}/in", [event("did:3", 5, when="2024-02-01T00:00:00+00:00")])
    assert run()[-1][1] == 1  # the state of the first two is gone
    text(spark, f"{folder}/in", [event("did:1", 6, when="2024-02-02T00:00:00+00:00")])
    run()
    assert kept() == 4  # so the edge is written again,
    assert values(live.read_edges(spark, f"{folder}/out").select("liker", "target")) == [(f"did:{i}", "did:9") for i in (1, 2, 3)]  # and read once


OPS = "did long, op_id long, ts timestamp, host string"


def test_moves_go_on_after_a_restart(spark, folder):
    at = lambda d: dt.datetime(2024, 1, d)
    parts = [[(1, 1, at(1), "a"), (2, 2, at(1), "a"), (1, 4, at(3), "b"), (1, 3, at(2), "c")], [(2, 5, at(4), "a"), (1, 6, at(4), "b")], [(1, 7, at(5), "a"), (2, 9, at(6), "c"), (2, 8, at(6), "b")]]
    for part in parts:
        spark.createDataFrame(part, OPS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        live.append_moves(stream(spark, f"{folder}/in", files=1), f"{folder}/out", f"{folder}/state", days=30).awaitTermination()
    want = [(1, 3, "a", "c", at(2)), (1, 4, "c", "b", at(3)), (1, 7, "b", "a", at(5)), (2, 8, "a", "b", at(6)), (2, 9, "b", "c", at(6))]
    assert values(spark.read.schema(live.MOVES).parquet(f"{folder}/out")) == want
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"  # as it was


def test_batches_are_kept_for_longer_than_spark_remembers(spark, folder):
    spark.range(0, 60, 1, 6).write.parquet(f"{folder}/in")
    with live.watched(spark, f"{folder}/progress") as progress, live.settings(spark, **{"spark.sql.streaming.numRecentProgressUpdates": "2"}):
        query = stream(spark, f"{folder}/in", files=1).writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        progress.wait(query)
    assert len(query.recentProgress) <= 2
    rows = progress.read().where(F.col("query") == str(query.id)).orderBy("batch").collect()
    assert [(r.batch, r.rows) for r in rows] == [(i, 10) for i in range(6)]
    assert all(r.total_ms >= r.write_ms >= 0 for r in rows)


def test_a_refresh_that_fails_leaves_the_old_rows(spark, folder, monkeypatch):
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, f"{folder}/t")
    assert sinks.refresh(spark.range(3), f"{folder}/t") == 0
    old = sinks.read_current(spark, f"{folder}/t")

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(sinks, "_mark", fail)
        with pytest.raises(OSError, match="lost"):
            sinks.refresh(spark.range(9), f"{folder}/t")
    assert values(sinks.read_current(spark, f"{folder}/t")) == [(0,), (1,), (2,)]
    # What failed is written over, and the table may be made from itself; readers of the version before go on.
    assert sinks.refresh(old.union(spark.range(7, 8)), f"{folder}/t") == 1
    assert values(old) == [(0,), (1,), (2,)]
    assert values(sinks.read_current(spark, f"{folder}/t")) == [(0,), (1,), (2,), (7,)]
    for k in range(3):
        sinks.refresh(spark.range(k), f"{folder}/t")
    assert sorted(x for x in os.listdir(folder.removeprefix("file://") + "/t") if x[0] == "v") == ["v3", "v4"]


@pytest.mark.parametrize("lost", [None, "_mark", "delete"])
def test_compaction_keeps_sums_wherever_it_fails(spark, folder, monkeypatch, lost):
    path, keys, how = f"{folder}/d", ["k"], {"n": "add", "mask": "or"}
    delta = lambda b: spark.createDataFrame([("a", b, 1 << b), (f"k{b}", 1, 1)], "k string, n long, mask int")
    for b in range(5):
        sinks.append_delta(delta(b), path, b)
    want = values(sinks.read_merged(spark, path, keys, how))

    def fail(*_):
        raise OSError("lost")

    for upto in (1, 3, 4):
        if lost:
            with monkeypatch.context() as m:
                m.setattr(sinks, lost, fail)
                try:
                    sinks.compact(spark, path, keys, how, upto)
                except OSError:
                    pass
            assert values(sinks.read_merged(spark, path, keys, how)) == want
        sinks.compact(spark, path, keys, how, upto)
        assert values(sinks.read_merged(spark, path, keys, how)) == want
    sinks.append_delta(delta(5), path, 5)
    assert dict((r.k, r.n) for r in sinks.read_merged(spark, path, keys, how).collect())["a"] == 15
    sinks.compact(spark, path, keys, how, 5)
    left = {int(x.split("=")[1]) for x in os.listdir(path.removeprefix("file://")) if x.startswith("batch=")}
    assert 0 not in left and 1 not in left


def test_batches_are_seen_if_they_are_committed(spark, folder):
    one = lambda n: {"a": spark.range(n, n + 2), "b": spark.range(n)}
    for b in range(2):
        sinks.commit_batch(spark, folder, b, one(b + 1))
    spark.range(99).write.parquet(f"{folder}/a/batch=2")
    assert values(sinks.read_committed(spark, folder, "a")) == [(1,), (2,), (2,), (3,)]
    assert values(sinks.read_committed(spark, folder, "b")) == [(0,), (0,), (1,)]


def test_changes_may_come_late_or_twice(spark, folder):
    day = lambda rows: spark.createDataFrame(rows, "k string, at int, v string, gone boolean")
    parts = [[("a", 1, "x", False), ("b", 5, "y", True)], [("a", 3, "z", True), ("b", 2, "old", False)], [("a", 4, "w", False), ("c", 1, None, True)]]
    for part in (parts[0], parts[2], parts[1], parts[2], parts[0]):
        sinks.apply_changes(f"{folder}/s", day(part), ["k"], "at", F.col("gone"))
    got = sinks.read_current(spark, f"{folder}/s").select("k", "at", F.coalesce("v", F.lit("-")), F.coalesce("deleted_at", F.lit(0)))
    assert values(got) == [("a", 4, "w", 0), ("b", 5, "y", 5), ("c", 1, "-", 1)]


def test_derived_tables_join_without_a_shuffle(spark, folder):
    a = sinks.derive(spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v")), "derived_a", f"{folder}/a", "k", 4)
    b = sinks.derive(spark.range(0, 500, 5).select(F.col("id").alias("k")), "derived_b", f"{folder}/b", "k", 4)
    joined = a.join(b.hint("merge"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 100
    assert "500 rows" in " ".join(r.data_type for r in spark.sql("DESCRIBE EXTENDED derived_a").collect() if r.col_name == "Statistics")
    for name in ("derived_a", "derived_b"):
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("name", ["snk11_derived_tables", "snk04_last_write", "sm12_rewound", "gm05_k_core", "gm25_nearest_centroid", "snk21_saved_vectors", "sm17_streamed_moves", "sm03_streamed_folds", "src17_pool", "q01_activity_by_age"])
def test_a_query_leaves_nothing_but_its_result(spark, sf_dir, name):
    where = scratch.scratch_dir(spark).removeprefix("file://")
    before = set(os.listdir(where))
    out = catalogue.queries()[name](spark, sf_dir)
    assert len(set(os.listdir(where)) - before) == (0 if name.startswith("q") else 1)
    assert out.count() > 0


def test_streamed_moves_are_those_of_the_log(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert values(catalogue.queries()["sm17_streamed_moves"](spark, sf_dir)) == values(t.migrations.select("did", "op_id", "from_host", "to_host", "ts"))
