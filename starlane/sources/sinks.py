"""Writing results: partitions replaced as a whole, deltas that replay without harm, reports as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.operators.archetypes import merge
from starlane.sources.scratch import delete, shared_folder

#: Names inside a table's folder: versions, marks of complete ones, and what compact() has merged (readers of the folder pass over names with an underscore).
VERSION, COMPLETE, MERGED = "v", "_complete", "_merged"


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that df has rows for are replaced; writing the same rows again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_delta(df: DataFrame, path: str, batch: int) -> None:
    """The batch's keyed sums as a partition of their own, replaced if the batch is replayed, so that sums never count twice."""
    replace_partitions(df.withColumn("batch", F.lit(batch)), path, ["batch"])


def read_merged(spark: SparkSession, path: str, keys: list[str], how: dict[str, str]) -> DataFrame:
    """Deltas merged by key when read: those that compact() has not merged yet, and what it has made of the others."""
    upto = latest_version(spark, f"{path}/{MERGED}")
    merged = None if upto is None else read_current(spark, f"{path}/{MERGED}").select(*keys, *how)
    if merged is not None and not any(p.getName().startswith("batch=") for p in _children(spark, path)):
        return merged
    deltas = spark.read.parquet(path)
    later = (deltas if upto is None else deltas.where(F.col("batch") > upto)).select(*keys, *how)
    return merge(later.limit(0) if merged is None else merged, later, keys, how)


def compact(spark: SparkSession, path: str, keys: list[str], how: dict[str, str], upto: int) -> None:
    """Merges the deltas of closed batches, those that will not be replayed, up to this one into one table, so that a reader doesn't open them all.

    The merged table's version is the number of its last batch, and readers take no delta up to that number; so a failure at any point leaves
    the sums as they were. Deltas go with the compaction after their own, when no reader of an older version is left.
    """
    before = latest_version(spark, f"{path}/{MERGED}")
    if before is not None and upto <= before:
        return
    closed = spark.read.parquet(path).where(F.col("batch") <= upto)
    new = (closed if before is None else closed.where(F.col("batch") > before)).select(*keys, *how)
    old = new.limit(0) if before is None else read_current(spark, f"{path}/{MERGED}").select(*keys, *how)
    refresh(merge(old, new, keys, how), f"{path}/{MERGED}", upto)
    for one in _children(spark, path):
        number = one.getName().removeprefix("batch=")
        if before is not None and one.getName() != number and int(number) <= before:
            delete(spark, one.toString())


def _children(spark: SparkSession, path: str) -> list:
    """Folders and files in a folder; none if it isn't there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath() for f in store.listStatus(folder)] if store.exists(folder) else []


def latest_version(spark: SparkSession, base: str) -> int | None:
    """The largest version that is complete."""
    return max((int(p.getName()) for p in _children(spark, f"{base}/{COMPLETE}") if p.getName().isdigit()), default=None)


def _mark(spark: SparkSession, base: str, version: int) -> None:
    """The switch: one empty file, made by one call of the store, which readers see or don't."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{COMPLETE}/{version}")
    mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()


def refresh(df: DataFrame, base: str, version: int | None = None, keep: int = 2) -> int:
    """Replaces a whole table: its rows are written as a new version beside the old one, and only then marked complete.

    Readers see the old rows or the new ones, never some of both or none; df may read the table itself. Versions but for the
    last `keep`, and leftovers of refreshes that failed, are deleted after the switch. The version's number.
    """
    spark = df.sparkSession
    before = latest_version(spark, base)
    version = (0 if before is None else before + 1) if version is None else version
    df.write.mode("overwrite").parquet(f"{base}/{VERSION}{version}")
    _mark(spark, base, version)
    done = sorted(int(p.getName()) for p in _children(spark, f"{base}/{COMPLETE}") if p.getName().isdigit())
    for old in done[:-keep]:
        delete(spark, f"{base}/{COMPLETE}/{old}")
    for one in _children(spark, base):
        if one.getName().startswith(VERSION) and int(one.getName().removeprefix(VERSION)) not in done[-keep:]:
            delete(spark, one.toString())
    return version


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """The last complete version of a table that refresh() writes."""
    version = latest_version(spark, base)
    if version is None:
        raise FileNotFoundError(f"no complete version in {base}")
    return spark.read.parquet(f"{base}/{VERSION}{version}")


def upsert(spark: SparkSession, path: str, delta: DataFrame, keys: list[str], how: dict[str, str], by: str, order: str | None = None) -> None:
    """Merges delta into a table partitioned by `by`, one of the keys: only its partitions are read and replaced. Replays change nothing, so sums are refused: append_delta is for them."""
    if "add" in how.values():
        raise ValueError("a sum would count twice if its delta came again; use append_delta")
    saved = shared_folder(spark)
    touched = [r[0] for r in delta.select(by).distinct().collect()]  # one value for each partition that changes
    old = spark.read.parquet(path).where(F.col(by).isin(touched))
    merge(old.select(*keys, *how), delta.select(*keys, *how), keys, how, order).write.parquet(saved)
    replace_partitions(spark.read.parquet(saved), path, [by])
    delete(spark, saved)


def with_tombstones(changes: DataFrame, keys: list[str], order: str, deleted: Column) -> DataFrame:
    """The last change of each key with deleted_at: when it went, if that was the last that happened; a later change brings it back."""
    plain = [c for c in changes.columns if c not in keys]
    last = changes.withColumn("deleted_at", F.when(deleted, F.col(order))).groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__o"), *plain, "deleted_at")).alias("l"))
    return last.select(*keys, *(f"l.{c}" for c in plain), "l.deleted_at")


def apply_changes(base: str, changes: DataFrame, keys: list[str], order: str, deleted: Column) -> int:
    """Changes laid upon a table of the last state of each key that refresh() keeps, with deleted_at: soft deletes, and what a later change brings back. Changes that come late or twice alter nothing. The new version's number."""
    spark = changes.sparkSession
    new = with_tombstones(changes, keys, order, deleted)
    if latest_version(spark, base) is not None:
        plain = [c for c in new.columns if c not in keys]
        both = read_current(spark, base).unionByName(new)
        new = both.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("__o"), *plain)).alias("l")).select(*keys, *(f"l.{c}" for c in plain))
    return refresh(new, base)


def derive(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """A derived table under a name, in buckets by a key and sorted in each, with statistics of all columns: joins and groups by that key need no shuffle, as they would use an index."""
    df.write.option("path", path).bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return df.sparkSession.table(name)


def prune(spark: SparkSession, path: str, by: str, first_kept: str | None) -> int:
    """Deletes partitions before first_kept (as their names sort); without it nothing. How many went."""
    if not first_kept:
        return 0
    old = [p for p in _children(spark, path) if p.getName().startswith(f"{by}=") and p.getName() < f"{by}={first_kept}"]
    for one in old:
        delete(spark, one.toString())
    return len(old)


def rewind(spark: SparkSession, path: str, by: str, first_full: str, replayed: DataFrame) -> None:
    """Additive days from first_full on are deleted and written again from what is replayed; the day on which the replay begins is partial and stays as it is."""
    saved = shared_folder(spark)
    replayed.where(F.col(by) >= F.lit(first_full)).write.parquet(saved)
    later = [r[0] for r in spark.read.parquet(path).where(F.col(by) >= F.lit(first_full)).select(F.col(by).cast("string")).distinct().collect()]  # one value for each day
    for day in later:
        delete(spark, f"{path}/{by}={day}")
    spark.read.parquet(saved).write.mode("append").partitionBy(by).parquet(path)
    delete(spark, saved)


def commit_batch(spark: SparkSession, base: str, batch: int, tables: dict[str, DataFrame]) -> None:
    """Several tables of one batch become visible together: each is written under the batch's number, and a mark after all of them."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
    spark.range(1).write.mode("overwrite").parquet(f"{base}/committed/batch={batch}")


def read_committed(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Rows of batches that are marked; of others nothing is seen."""
    marks = spark.read.parquet(f"{base}/committed").select("batch").distinct()
    return spark.read.parquet(f"{base}/{name}").join(marks, "batch", "left_semi").drop("batch")


def report(df: DataFrame, path: str) -> bool:
    """A CSV report with a header, quoted as RFC 4180 has it; nothing at all is written for no rows. Whether it was written."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def json_lines(df: DataFrame, path: str, by: list[str]) -> None:
    """JSON lines in folders by column, as in dt=2024-01-01/hr=07."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def bundle(variants: dict[str, DataFrame], path: str, rest: str = "variant") -> None:
    """Results in variants (such as with and without the platform's own hosts) as JSON lines, each row with its variant's name."""
    out = None
    for name, df in variants.items():
        rows = df.select(F.lit(name).alias(rest), F.to_json(F.struct("*")).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    out.write.mode("overwrite").json(path)
