"""Window functions.

An aggregate over a partition with an order but no frame covers the whole
partition, and orders put nulls last going up and first going down.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from sparkloom.functions._base import col

row_number, rank, dense_rank = F.row_number, F.rank, F.dense_rank


def ordering(by, desc=False, nulls_first=None) -> list[Column]:
    """Sort columns; nulls count as greatest unless told otherwise."""
    by = by if isinstance(by, (list, tuple)) else [by]
    desc = desc if isinstance(desc, (list, tuple)) else [desc] * len(by)
    nulls = nulls_first if isinstance(nulls_first, (list, tuple)) else [nulls_first] * len(by)
    out = []
    for c, d, n in zip(map(col, by), desc, nulls, strict=True):
        first = d if n is None else n
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if d else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


class Window:
    """A window specification: partition_by, order_by, rows_between, range_between."""

    unbounded_preceding, unbounded_following, current_row = SparkWindow.unboundedPreceding, SparkWindow.unboundedFollowing, 0

    def __init__(self, parts=(), order=(), frame=None, min_periods: int = 1):
        self.parts, self.order, self.frame, self.min_periods = tuple(parts), tuple(order), frame, min_periods

    def partition_by(self, *cols) -> Window:
        return Window((*self.parts, *map(col, cols)), self.order, self.frame, self.min_periods)

    def order_by(self, *cols, desc=False, nulls_first=None) -> Window:
        return Window(self.parts, (*self.order, *ordering(list(cols), desc, nulls_first)), self.frame, self.min_periods)

    def rows_between(self, start=SparkWindow.unboundedPreceding, end=SparkWindow.unboundedFollowing, min_periods: int = 1) -> Window:
        return Window(self.parts, self.order, ("rows", start, end), min_periods)

    def range_between(self, start=SparkWindow.unboundedPreceding, end=SparkWindow.unboundedFollowing, min_periods: int = 1) -> Window:
        return Window(self.parts, self.order, ("range", start, end), min_periods)

    def spec(self, ranking: bool = False) -> WindowSpec:
        out = SparkWindow.partitionBy(*self.parts)
        if self.order:
            out = out.orderBy(*self.order)
        if self.frame:
            return (out.rowsBetween if self.frame[0] == "rows" else out.rangeBetween)(*self.frame[1:])
        return out if ranking else out.rowsBetween(SparkWindow.unboundedPreceding, SparkWindow.unboundedFollowing)


def over(expr: Column, window: Window | WindowSpec) -> Column:
    """An aggregate over a window; frames with fewer rows than min_periods give null."""
    if isinstance(window, WindowSpec):
        return expr.over(window)
    out = expr.over(window.spec())
    return F.when(F.count(F.lit(1)).over(window.spec()) >= window.min_periods, out) if window.min_periods > 1 else out


def ranked(expr: Column, window: Window) -> Column:
    """A ranking function or an offset over a window."""
    return expr.over(window.spec(ranking=True))


def lag(expr, offset: int = 1, default=None) -> Column:
    return F.lag(col(expr), offset, default)


def lead(expr, offset: int = 1, default=None) -> Column:
    return F.lead(col(expr), offset, default)


def first_value(expr, ignore_nulls: bool = False) -> Column:
    return F.first_value(col(expr), ignore_nulls)


def last_value(expr, ignore_nulls: bool = False) -> Column:
    return F.last_value(col(expr), ignore_nulls)
