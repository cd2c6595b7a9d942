"""Queries over the driver's tables, each with its SQL equivalent where there is one."""

from catalog.base import QUERIES, SQL
from catalog import (  # noqa: F401
    cleaning, cohort, columns, description, models, persistence, ranks, sources,
)

__all__ = ["QUERIES", "SQL"]
