"""Named queries over the test tables, each with the SQL that must give the same rows."""

from chronopanel.queries.base import QUERIES, SQL
from chronopanel.queries import (  # noqa: F401  (registration)
    backtests,
    comparison,
    dependence,
    features,
    profiling,
    quality,
    tables,
)

__all__ = ["QUERIES", "SQL"]
