"""Aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col, lit, rename

rename({"min": F.min, "max": F.max, "bool_and": F.bool_and, "bool_or": F.bool_or, "median": F.median, "mean": F.avg, "avg": F.avg, "skew": F.skewness, "sum": F.sum, "count_distinct": F.count_distinct, "approx_count_distinct": F.approx_count_distinct, "list_agg_distinct": F.collect_set}, globals())


def count(expr="*", mode: str = "valid") -> Column:
    """Rows with a value; mode ``all`` counts every row, ``null`` those without."""
    if isinstance(expr, str) and expr == "*" or mode == "all":
        return F.count(F.lit(1))
    return F.count(col(expr)) if mode == "valid" else F.count_if(col(expr).isNull())


def product(expr) -> Column:
    return F.product(col(expr))


def approx_percentiles(expr, percentiles, accuracy: int = 10_000) -> Column:
    many = isinstance(percentiles, (list, tuple))
    return F.percentile_approx(col(expr), list(percentiles) if many else percentiles, accuracy)


def percentile(expr, percentage) -> Column:
    """Exact, between neighbours by linear interpolation."""
    return F.percentile(col(expr), percentage)


def var(expr, ddof: int = 1) -> Column:
    """Variance with any ddof; null where there are no more values than that."""
    c = col(expr).cast("double")
    if ddof in (0, 1):
        return F.var_samp(c) if ddof else F.var_pop(c)
    n = F.count(c)
    return F.when(n > ddof, F.var_pop(c) * n / (n - ddof))


def stddev(expr, ddof: int = 1) -> Column:
    return F.sqrt(var(expr, ddof))


def any_value(expr, ignore_nulls: bool = False) -> Column:
    return F.any_value(col(expr), lit(ignore_nulls))


def list_agg(expr) -> Column:
    """All values in a list, nulls included."""
    return F.transform(F.collect_list(F.struct(col(expr).alias("v"))), lambda s: s["v"])


def string_agg(expr, delimiter: str = "") -> Column:
    return F.listagg(col(expr), F.lit(delimiter))


def list_concat_agg(expr) -> Column:
    """The lists of a group as one list."""
    return F.flatten(F.collect_list(col(expr)))


def distinct_sketch(expr, lg_k: int = 12) -> Column:
    """A mergeable sketch (HyperLogLog) of a group's distinct values, as bytes that can be stored."""
    return F.hll_sketch_agg(col(expr), F.lit(lg_k))


def merge_sketch(expr) -> Column:
    """One sketch of many, by merging."""
    return F.hll_union_agg(col(expr))


def sketch_distinct(expr) -> Column:
    """The number of distinct values that a sketch stands for."""
    return F.hll_sketch_estimate(col(expr))


def quantile_sketch(expr, k: int = 200) -> Column:
    """A mergeable sketch of a group's numbers from which quantiles are read."""
    return F.kll_sketch_agg_double(col(expr).cast("double"), F.lit(k))


def merge_quantile_sketches(left, right) -> Column:
    return F.kll_sketch_merge_double(col(left), col(right))


def sketch_quantile(expr, rank: float) -> Column:
    return F.kll_sketch_get_quantile_double(col(expr), F.lit(rank))
