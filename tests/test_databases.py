"""Databases by JDBC, with the embedded one that Spark ships: ranges of a key, pushed filters, and a join over two databases."""

import pytest
from pyspark.sql import functions as F

from starlane.sources import tables

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def urls(spark):
    """Two databases in the driver's memory, which tasks of a local master share."""
    out = {name: f"jdbc:derby:memory:{name};create=true" for name in ("log", "health")}
    rows = spark.range(1000).select(F.col("id").alias("did"), F.concat(F.lit("host"), F.col("id") % 7).alias("host"))
    rows.write.jdbc(out["log"], "accounts", mode="overwrite", properties=DRIVER)
    hosts = spark.createDataFrame([(f"host{i}", f"city{i % 3}") for i in range(5)], "host string, city string")
    hosts.write.jdbc(out["health"], "places", mode="overwrite", properties=DRIVER)
    return out


def test_a_table_is_read_in_ranges_of_its_key(spark, urls):
    df = tables.jdbc(spark, urls["log"], "SELECT * FROM accounts", key="did", bounds=(0, 1000), parts=8, **DRIVER)
    assert df.rdd.getNumPartitions() == 8
    assert sorted(len(p) for p in df.rdd.glom().collect()) == [125] * 8
    # Keys outside of the bounds are in the first and last range.
    narrow = tables.jdbc(spark, urls["log"], "SELECT * FROM accounts", key="did", bounds=(400, 600), parts=4, **DRIVER)
    assert narrow.count() == 1000
    assert sorted(r[0] for r in df.select("did").collect()) == list(range(1000))


def test_filters_and_columns_reach_the_database(spark, urls):
    df = tables.jdbc(spark, urls["log"], "SELECT * FROM accounts", **DRIVER).where("did < 10").select("host")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(did,10)" in plan or "DID" in plan.upper() and "< 10" in plan
    assert df.count() == 10


def test_two_databases_in_one_statement(spark, urls):
    tables.attach(spark, urls, {"log": ["accounts"], "health": ["places"]}, **DRIVER)
    got = spark.sql("SELECT city, count(*) AS n FROM log_accounts JOIN health_places USING (host) GROUP BY city").collect()
    want = {}
    for i in range(1000):
        if i % 7 < 5:
            want[f"city{i % 7 % 3}"] = want.get(f"city{i % 7 % 3}", 0) + 1
    assert {r.city: r.n for r in got} == want
