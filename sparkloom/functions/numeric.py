"""Numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col, lit, rename

_ONE = "abs ceil floor sqrt cbrt sin cos tan csc sec cot sinh cosh tanh radians degrees factorial exp expm1 bin negate sign arcsin arccos arctan arcsinh arccosh arctanh"
_OTHER = {"negate": "negative", "sign": "signum"} | {f"arc{x}": f"a{x}" for x in ("sin", "cos", "tan", "sinh", "cosh", "tanh")}
rename({n: getattr(F, _OTHER.get(n, n)) for n in _ONE.split()}, globals())


def e() -> Column:
    return F.e()


def pi() -> Column:
    return F.pi()


def _ieee(value: Column, c: Column, zero: float = 0.0) -> Column:
    """Logarithms of zero and below as floats have them: -inf and NaN."""
    c = c.cast("double")
    return F.when(c == zero, F.lit(-math.inf)).when(c < zero, F.lit(math.nan)).otherwise(value)


def ln(expr) -> Column:
    return _ieee(F.ln(col(expr)), col(expr))


def log2(expr) -> Column:
    return _ieee(F.log2(col(expr)), col(expr))


def log10(expr) -> Column:
    return _ieee(F.log10(col(expr)), col(expr))


def log(expr, base: float = math.e) -> Column:
    return _ieee(F.ln(col(expr)) / math.log(base), col(expr))


def log1p(expr) -> Column:
    return _ieee(F.log1p(col(expr)), col(expr), -1.0)


def clip(expr, min=None, max=None) -> Column:  # noqa: A002
    """Null bounds don't bound; a null value stays null."""
    c, out = col(expr), col(expr)
    out = out if min is None else F.greatest(out, lit(min))
    out = out if max is None else F.least(out, lit(max))
    return F.when(c.isNotNull(), out)


def round(expr, decimals: int = 0) -> Column:  # noqa: A001
    return F.round(col(expr), decimals)


def arctan2(y, x) -> Column:
    return F.atan2(col(y), col(x))


def hypot(a, b) -> Column:
    return F.hypot(col(a), col(b))


def pow(base, expr) -> Column:  # noqa: A001
    return F.pow(col(base), col(expr))


power = pow


def pmod(a, b) -> Column:
    return F.pmod(col(a), col(b))


def true_divide(a, b) -> Column:
    """Division in doubles; by zero it gives an infinity or NaN."""
    x, y = col(a).cast("double"), col(b).cast("double")
    return F.when(y != 0, F.try_divide(x, y)).when(y == 0, F.when(F.isnan(x) | (x == 0), F.lit(math.nan)).when(x > 0, F.lit(math.inf)).when(x < 0, F.lit(-math.inf)))


def floor_divide(a, b) -> Column:
    return F.floor(F.try_divide(col(a).cast("double"), col(b).cast("double"))).cast("long")


def try_divide(a, b) -> Column:
    return F.try_divide(col(a), col(b))


def between(expr, lower, upper) -> Column:
    return col(expr).between(lit(lower), lit(upper))


def conv(expr, from_base: int, to_base: int) -> Column:
    return F.conv(col(expr), from_base, to_base)


def is_nan(expr) -> Column:
    return F.when(col(expr).isNotNull(), F.isnan(col(expr)))


def not_nan(expr) -> Column:
    return ~is_nan(expr)


def is_inf(expr) -> Column:
    return col(expr).isin(math.inf, -math.inf)


def fill_nan(expr, fill_value) -> Column:
    return F.nanvl(col(expr), lit(fill_value))


def bitwise_and(a, b) -> Column:
    return col(a).bitwiseAND(col(b))


def bitwise_or(a, b) -> Column:
    return col(a).bitwiseOR(col(b))


def bitwise_xor(a, b) -> Column:
    return col(a).bitwiseXOR(col(b))


def shift_left(expr, num_bits: int) -> Column:
    return F.shiftleft(col(expr), num_bits)


def shift_right(expr, num_bits: int) -> Column:
    return F.shiftright(col(expr), num_bits)


def columns_sum(*exprs) -> Column:
    """Sum of a row's columns without its nulls; null where all are."""
    from sparkloom.functions.lists import list_sum

    return list_sum(F.array(*map(col, exprs)))


def columns_mean(*exprs) -> Column:
    from sparkloom.functions.lists import list_mean

    return list_mean(F.array(*map(col, exprs)))


columns_avg = columns_mean


def columns_min(*exprs) -> Column:
    return F.array_min(F.array(*map(col, exprs)))


def columns_max(*exprs) -> Column:
    return F.array_max(F.array(*map(col, exprs)))


def great_circle_distance(lat1, lon1, lat2, lon2) -> Column:
    """Metres by the haversine formula; null outside of the ranges of latitude and longitude."""
    a, b, c, d = map(col, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(c - a) / 2), 2) + F.cos(F.radians(a)) * F.cos(F.radians(c)) * F.pow(F.sin(F.radians(d - b) / 2), 2)
    return F.when(a.between(-90, 90) & c.between(-90, 90) & b.between(-180, 180) & d.between(-180, 180), 2 * 6371008.8 * F.asin(F.sqrt(F.least(F.lit(1.0), h))))
