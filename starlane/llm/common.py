"""Shared by the operators: words as columns, table access, and tables written to the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.sources.scratch import scratch_dir

#: ASCII white space, as a Java regular expression; what lies between are the plain words.
SPACE = r"[\x20\x09-\x0D]+"
#: Everything in ASCII but digits and (after lower-casing) letters; what lies between are the folded words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read, dealt over all cores if its files make fewer tasks than there are (so it is small)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Folders that are written inside `scratch_tables`, in order. Each run has its own list, whatever runs beside it.
_tables: ContextVar[list[str] | None] = ContextVar("scratch_tables", default=None)


@contextmanager
def scratch_tables() -> Iterator[list[str]]:
    """The tables that operators write inside, for release(); without it they stay until the scratch folder is cleared."""
    written: list[str] = []
    token = _tables.set(written)
    try:
        yield written
    finally:
        _tables.reset(token)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the scratch folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    written = _tables.get()
    if written is not None:
        written.append(path)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, written: list[str]) -> None:
    """Deletes the tables listed but for the last; only for a caller that has used up all but that one."""
    for path in written[:-1]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del written[:-1]


def finished(df: Callable[[], DataFrame], name: str) -> DataFrame:
    """A result written out as a table; what its operator wrote on the way there is deleted."""
    with scratch_tables() as written:
        out = materialize(df(), name)
        release(out.sparkSession, written)
    return out


def plain_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; no word for null."""
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def folded_words(text: Column) -> Column:
    """Runs of digits, letters and all beyond ASCII, with A-Z (only) lower-cased; no word for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), NOT_WORD), ""), F.array().cast("array<string>"))
