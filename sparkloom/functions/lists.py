"""Lists.  Indices start at 0, aggregates skip nulls, and a list without values gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col, lit, rename

rename({"list_flatten": F.flatten, "list_min": F.array_min, "list_max": F.array_max}, globals())


def _real(expr) -> Column:
    return F.filter(col(expr), lambda x: x.isNotNull())


def list_count(expr, mode: str = "valid") -> Column:
    c = col(expr)
    n = {"valid": F.size(_real(c)), "all": F.size(c), "null": F.size(c) - F.size(_real(c))}[mode]
    return F.when(c.isNotNull(), n)


def list_sum(expr) -> Column:
    real = _real(expr)
    return F.when(F.size(real) > 0, F.aggregate(F.slice(real, 2, F.greatest(F.size(real), F.lit(1))), F.element_at(real, 1), lambda a, x: a + x))


def list_mean(expr) -> Column:
    real = _real(F.transform(col(expr), lambda x: x.cast("double")))
    return list_sum(real) / F.when(F.size(real) > 0, F.size(real))


def list_bool_and(expr) -> Column:
    real = _real(expr)
    return F.when(F.size(real) > 0, F.forall(real, lambda x: x))


def list_bool_or(expr) -> Column:
    real = _real(expr)
    return F.when(F.size(real) > 0, F.exists(real, lambda x: x))


def list_sort(expr, desc: bool = False, nulls_first: bool | None = None) -> Column:
    """Nulls go last going up and first going down, unless told otherwise."""
    first = desc if nulls_first is None else nulls_first
    real, gone = F.sort_array(_real(expr), asc=not desc), F.filter(col(expr), lambda x: x.isNull())
    return F.concat(gone, real) if first else F.concat(real, gone)


def list_distinct(expr) -> Column:
    return F.array_distinct(F.array_compact(col(expr)))


def list_join(expr, delimiter: str) -> Column:
    return F.array_join(col(expr), delimiter)


def list_map(expr, mapper: Callable[[Column], Column]) -> Column:
    return F.transform(col(expr), mapper)


def list_filter(expr, predicate: Callable[[Column], Column]) -> Column:
    return F.filter(col(expr), predicate)


def list_append(expr, other) -> Column:
    return F.array_append(col(expr), lit(other))


def list_contains(expr, item) -> Column:
    return F.array_contains(col(expr), lit(item))


def value_counts(expr) -> Column:
    """A map from each value to how often it stands in the list."""
    c = col(expr)
    return F.map_from_entries(F.transform(F.array_distinct(_real(c)), lambda v: F.struct(v, F.size(F.filter(c, lambda x: x == v)).cast("long"))))


def chunk(expr, size: int) -> Column:
    """Lists of ``size`` neighbours; a short tail is dropped."""
    c, n = col(expr), F.floor(F.size(col(expr)) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(c, i * size + 1, F.lit(size)))
    return F.when(c.isNotNull(), F.when(n > 0, parts).otherwise(F.slice(parts, 1, 0)))


def list_slice(expr, start, end=None) -> Column:
    """Elements start..end, negative places counted from the end."""
    c, n = col(expr), F.size(col(expr))
    place = lambda p: F.greatest(F.lit(0), F.least(n, F.when(lit(p) < 0, lit(p) + n).otherwise(lit(p))))
    a, b = place(start), n if end is None else place(end)
    return F.when(c.isNotNull(), F.slice(c, a.cast("int") + 1, F.greatest(F.lit(0), b - a).cast("int")))


def explode(expr, ignore_empty_and_null: bool = False) -> Column:
    """A row for each element; lists without any give one row with null unless they're ignored."""
    return F.explode(col(expr)) if ignore_empty_and_null else F.explode_outer(col(expr))


def seq(n) -> Column:
    """0..n-1."""
    n = col(n)
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1)).when(n.isNotNull(), F.slice(F.array(F.lit(0).cast("long")), 1, 0))


def to_list(*items) -> Column:
    return F.array(*map(col, items))


def slice(expr, start, end=None) -> Column:  # noqa: A001
    """Elements start..end of a list."""
    return list_slice(expr, start, end)
