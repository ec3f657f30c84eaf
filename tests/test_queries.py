"""Every registered query against its SQL on the small tables: columns, types and values."""

import math
import os

import duckdb
import pytest

from starlane.plans import catalogue
from starlane.sources.bindings import GIVEN

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in GIVEN:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return v.isoformat().replace("T00:00:00", "") if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    sql = duck.sql(SQL[name])
    order = sorted(df.columns)
    assert order == sorted(sql.columns)
    kinds = dict(zip(sql.columns, map(str, sql.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    at = [sql.columns.index(c) for c in order]
    got = sorted(tuple(map(shown, r)) for r in df.select(*order).collect())
    want = sorted(tuple(shown(r[i]) for i in at) for r in sql.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
