"""Each stage against a plain version of it, on the small documents, and on odd rows."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from starlane.llm import mixing, toxicity
from starlane.llm.common import materialize

from .test_operators import PLAIN, brute_components, brute_contamination

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = materialize(stage(spark, docs, D), name)
        out.append((name, docs, after))
        docs = after
    return {n: (a, b) for n, a, b in out}


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_columns(steps, spark):
    want = spark.read.parquet(f"{D}/documents.parquet").columns
    assert all(b.columns == want for n, (_, b) in steps.items() if n != "sharding")


def test_toxicity(steps, spark):
    before, after = steps["toxicity"]
    field = toxicity.fit(before, spark.read.parquet(f"{D}/labels.parquet"))
    want = toxicity.score(before, field).where("score < 0.5").select(*before.columns)
    assert rows(after) == rows(want) and after.count() > 0.7 * before.count()


def test_near_duplicates(steps):
    before, after = steps["near_duplicates"]
    got = before.collect()
    want = brute_components([r.doc_id for r in got], [r.text for r in got], pipeline.WORDS, pipeline.PERCENT)
    assert {r.doc_id for r in after.collect()} == {c for d, n, c in want} and after.count() == len({c for d, n, c in want})


def test_decontamination(steps, spark):
    before, after = steps["decontamination"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    bad = {k[0] for k in brute_contamination([(r.doc_id, r.text) for r in before.collect()], items) if k[-1]}
    assert bad and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - bad


def test_mixing(steps):
    before, after = steps["mixing"]
    taken = {r.doc_id: r.taken for r in mixing.mix(before).collect()}
    copies = Counter(r.doc_id for r in after.collect())
    for r in before.collect():
        n = len(PLAIN.findall(r.text or ""))
        assert copies[r.doc_id] * n == taken[r.doc_id]


def test_sharding(steps):
    before, after = steps["sharding"]
    assert after.count() == before.count()
    by = after.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    assert all(r.n == r.last + 1 == r.slots for r in by)


def test_odd_rows_pass_through(spark, odd, nothing):
    for docs in (odd, nothing):
        step = docs
        for name, stage in pipeline.STAGES:
            step = materialize(stage(spark, step, D), name)
            assert name == "sharding" or step.columns == odd.columns


def test_run(spark):
    assert pipeline.run(spark, D).count() > 0
