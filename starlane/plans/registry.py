"""Where named queries are registered, each with the SQL that it is checked against (over {tables})."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starlane.functions.expr import JUNK, MOST_URL
from starlane.sources.bindings import Tables, as_sql
from starlane.sources.scratch import finished

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers f(tables) under a name; of what it writes on the way only the result stays."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: finished(spark, lambda: f(Tables(spark, sf_dir)))
        if sql:
            SQL[name] = as_sql(sql)
        return f

    return register


def pct(part: str, whole: str, digits: int = 2) -> str:
    """SQL of expr.percent."""
    return rnd(f"100.0::DOUBLE * ({part}) / nullif({whole}, 0)", digits)


def rnd(x: str, digits: int) -> str:
    """SQL of expr.round_to."""
    return f"floor(({x}) * {10**digits}.0::DOUBLE + 0.5::DOUBLE) / {10**digits}.0::DOUBLE"


def spread(x: str) -> str:
    """SQL of expr.spread."""
    return f"sqrt(greatest(avg(({x}) * ({x})) - avg({x}) * avg({x}), 0.0::DOUBLE))"


def long_sum(condition: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {condition} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def public_host(url: str) -> str:
    """SQL of expr.public_host."""
    return " AND ".join([*(f"{url} NOT LIKE '{p}'" for p in JUNK), f"({url} LIKE 'http://%' OR {url} LIKE 'https://%')", f"strpos(substr({url}, strpos({url}, '://') + 3), '.') > 0", f"length({url}) <= {MOST_URL}"])
