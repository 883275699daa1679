"""Queries over the given tables, each with its SQL for comparison."""

from sourceloom.plans import (  # noqa: F401  (importing registers the queries)
    analysis,
    edges,
    files,
    lookups,
    pages,
    project,
    scalars,
    vectors,
)
from sourceloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
