"""The named queries and the SQL that each is checked against."""

from __future__ import annotations

from starlane.plans import choices, cohorts, collectors, cubes, details, graphs, hosts, models, passing, places, records, streams, writes  # noqa: F401  (register)
from starlane.plans.registry import QUERIES, SQL
from starlane.streaming import folds

folds.register()


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
