"""A corpus pipeline of five stages; each takes what the one before it has kept.

run(spark, sf_dir) applies them to `documents`; every stage's output is written as Parquet into the shared scratch folder and read
back, so that the lineage of a later stage starts at a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starlane.llm import decontaminate, mixing, near, sharding, toxicity
from starlane.llm.common import materialize, release, scratch_tables, spread, table

#: Near duplicates: shingles of five words, a similarity of 0.8 or more.
WORDS, PERCENT = 5, 80
SHARE, CAP, WEIGHTS = 1.5, 2.0, (5, 2, 1)
SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, fitted on the labels of the documents that came in; documents that it predicts to be toxic go."""
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, field)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2; of each group the document with the smallest id stays. Documents without words are in no group and stay."""
    return near.one_of_each(docs, WORDS, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3; documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; every document as often as the mix takes it (0, 1 or 2 times)."""
    return mixing.mixed_rows(docs, share=SHARE, cap=CAP, weights=WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1; the shard and slot of every row."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The field, the join and the ring cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    with scratch_tables() as written:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            release(spark, written)  # all that was written before this stage's output has been used
    return docs
