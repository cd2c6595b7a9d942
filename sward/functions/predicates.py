"""Predicates and conditionals with the null rules of survey scripts.

Spark's three-valued logic differs from those rules in a few places: a negated
membership test keeps nulls, a conditional with an unknown test is unknown, and
an aggregate over a column with a missing value is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def not_in(column: Column, values: Sequence) -> Column:
    """True for every value outside ``values``, null included."""
    return ~F.coalesce(column.isin(list(values)), F.lit(False))


def ifelse(condition: Column, yes, no) -> Column:
    """Conditional value that is null when the condition is null."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(condition, yes).when(~condition, no)


def ifelse_in(column: Column, values: Sequence, yes, no) -> Column:
    """Conditional on membership; a null is simply not a member."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(column.isin(list(values)), yes).otherwise(no)


def strict(aggregate: Column, column: Column) -> Column:
    """The aggregate, or null when any input value of the group is null."""
    return F.when(F.count(F.lit(1)) == F.count(column), aggregate)


def has_prefix(column: Column, prefix: str) -> Column:
    """Whether the text starts with ``prefix``."""
    return column.startswith(prefix)


def except_where(column: Column, value, other: Column, kept) -> Column:
    """Keep every row except those with ``column == value`` and ``other`` not in ``kept``."""
    return ~((column == value) & ~other.isin(list(kept)))
