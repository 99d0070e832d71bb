"""Helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A column from a name or a column."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def lit(x) -> Column:
    """A column from a value or a column; strings are values."""
    return x if isinstance(x, Column) else F.lit(x)


def rename(names: dict[str, object], into: dict) -> None:
    """Put one-argument wrappers of Spark functions into a module."""
    for name, f in names.items():

        def wrapped(expr, _f=f):
            return _f(col(expr))

        wrapped.__name__ = name
        wrapped.__doc__ = f"Spark's {getattr(f, '__name__', name)} of a column."
        into[name] = wrapped
