from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_col(c) -> Column:
    """Accept a Column or a column name."""
    return c if isinstance(c, Column) else F.col(c)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row: the optimiser may
    write an expression into a lambda, where it is computed per element."""
    return F.get(F.transform(F.array(value), use), 0)


EMPTY_STRINGS = "array<string>"
