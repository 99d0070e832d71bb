"""Distances between vectors (lists of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot_product(left, right) -> Column:
    return _total(F.zip_with(col(left), col(right), lambda x, y: x.cast("double") * y.cast("double")))


def _norm(c: Column) -> Column:
    return F.sqrt(dot_product(c, c))


def cosine_similarity(left, right) -> Column:
    a, b = col(left), col(right)
    return F.try_divide(dot_product(a, b), _norm(a) * _norm(b))


def cosine_distance(left, right) -> Column:
    return 1 - cosine_similarity(left, right)


def euclidean_distance(left, right) -> Column:
    return F.sqrt(_total(F.zip_with(col(left), col(right), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def pearson_correlation(left, right) -> Column:
    center = lambda c: F.transform(c, lambda x: x.cast("double") - _total(F.transform(c, lambda y: y.cast("double"))) / F.size(c))
    return cosine_similarity(center(col(left)), center(col(right)))


def jaccard_similarity(left, right) -> Column:
    """Places where both vectors are not 0, by places where one is."""
    a, b = col(left), col(right)
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) & (y != 0)), lambda v: v))
    some = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda v: v))
    return F.try_divide(both.cast("double"), some.cast("double"))


def hamming_distance(left, right) -> Column:
    """Differing bits of two integers."""
    return F.bit_count(col(left).bitwiseXOR(col(right)))
