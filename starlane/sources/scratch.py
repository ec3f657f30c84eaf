"""The folder for intermediate tables. Driver and executors must share it, so on a cluster the session has to name it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder of its own if the master is local (tests), an error otherwise."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Folders made inside `recorded`; each run has its own list, whatever runs beside it.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are made inside, for delete(); without it they stay until the scratch folder is cleared."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder below it."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame) -> DataFrame:
    """df written into the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What build returns; if it made folders on the way, its result is written as a table of its own and they are deleted."""
    with recorded() as made:
        out = build()
    if not made:
        return out
    result = saved(out)
    for path in made:
        delete(spark, path)
    return result
