"""All named queries of the package with their SQL."""

from __future__ import annotations

from skein.operators import analytics, evolve, layouts, ordered, queues, relational, sinks  # noqa: F401  they register their queries
from skein.operators.registry import QUERIES, SQL
from skein.streaming import queries as streaming  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
