"""Reading the given tables; only Spark's readers touch the path, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; types are as given, or inferred (which reads it twice). Quotes are doubled inside quotes."""
    reader = spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a schema; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def jdbc(spark: SparkSession, url: str, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64, **options: str) -> DataFrame:
    """Rows of a database, in ranges of a numeric key if bounds are given; its driver has to be on the session's classpath."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) t", **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def attach(spark: SparkSession, databases: dict[str, str], tables: dict[str, list[str]], **options: str) -> None:
    """Tables of several databases under names of one session: the view <database>_<table> for each, so that one statement can join them. Nothing is read until it is asked for."""
    for database, url in databases.items():
        for name in tables[database]:
            jdbc(spark, url, f"SELECT * FROM {name}", **options).createOrReplaceTempView(f"{database}_{name}")
