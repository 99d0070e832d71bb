"""Dates and times.  Weeks and weekdays start on Monday, which is 0."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col, lit, rename

_ONE = {"date": "to_date", "day": "dayofmonth", "day_of_month": "dayofmonth", "dayofmonth": "dayofmonth", "hour": "hour", "minute": "minute", "second": "second", "month": "month", "quarter": "quarter", "year": "year", "day_of_week": "weekday", "day_of_year": "dayofyear", "dayofyear": "dayofyear", "week_of_year": "weekofyear", "weekofyear": "weekofyear", "date_from_unix_date": "date_from_unix_date", "timestamp_seconds": "timestamp_seconds", "timestamp_millis": "timestamp_millis", "timestamp_micros": "timestamp_micros", "last_day": "last_day"}
rename({n: getattr(F, f) for n, f in _ONE.items()}, globals())
current_date, current_timestamp, current_timezone = F.current_date, F.current_timestamp, F.current_timezone

_JAVA = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "Z": "z", "z": "xx", "e": "d", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "'%'"}


def java_pattern(strftime: str) -> str:
    """A strftime pattern as Spark's."""
    out = []
    for part in re.findall(r"%.|[^%]+", strftime):
        if part[0] == "%":
            if part[1] not in _JAVA:
                raise ValueError(f"no such field: {part}")
            out.append(_JAVA[part[1]])
        else:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", part).replace("''", "''"))
    return "".join(out)


def micros(expr) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(col(expr).cast("timestamp"))


def millisecond(expr) -> Column:
    return F.floor(F.pmod(micros(expr), F.lit(1_000_000)) / 1000).cast("int")


def microsecond(expr) -> Column:
    return F.pmod(micros(expr), F.lit(1_000_000)).cast("int")


def nanosecond(expr) -> Column:
    return (F.pmod(micros(expr), F.lit(1_000_000)) * 1000).cast("int")


def unix_date(expr) -> Column:
    return F.unix_date(col(expr).cast("date"))


def time(expr) -> Column:
    """The time of day as text with microseconds."""
    return F.date_format(col(expr), "HH:mm:ss.SSSSSS")


def strftime(expr, format: str = "%Y-%m-%dT%H:%M:%S.%f") -> Column:  # noqa: A002
    return F.date_format(col(expr), java_pattern(format))


date_format = strftime


def _span(expr) -> Column:
    """A day-time interval in microseconds."""
    return (F.unix_micros(F.timestamp_seconds(F.lit(0)) + col(expr))).cast("long")


def total_microseconds(expr) -> Column:
    return _span(expr)


def total_nanoseconds(expr) -> Column:
    return _span(expr) * 1000


def _whole(per: int):
    def of(expr) -> Column:
        return (F.signum(_span(expr)) * F.floor(F.abs(_span(expr)) / per)).cast("long")

    return of


total_milliseconds, total_seconds, total_minutes, total_hours, total_days = map(_whole, (1000, 10**6, 6 * 10**7, 36 * 10**8, 864 * 10**8))


def to_date(expr, format: str) -> Column:  # noqa: A002
    return F.to_date(col(expr), java_pattern(format))


def to_datetime(expr, format: str, timezone: str | None = None) -> Column:  # noqa: A002
    out = F.to_timestamp_ntz(col(expr), F.lit(java_pattern(format)))
    return out if timezone is None else F.to_utc_timestamp(out.cast("timestamp"), timezone)


def convert_time_zone(expr, to_timezone: str, from_timezone: str = "UTC") -> Column:
    return F.convert_timezone(F.lit(from_timezone), F.lit(to_timezone), col(expr).cast("timestamp_ntz"))


def convert_timezone(target_timezone: str, source_timestamp) -> Column:
    return convert_time_zone(source_timestamp, target_timezone)


def replace_time_zone(expr, timezone: str | None = None) -> Column:
    """The same wall clock in another zone; without one, no zone."""
    return col(expr).cast("timestamp_ntz") if timezone is None else F.to_utc_timestamp(col(expr).cast("timestamp"), timezone)


def from_utc_timestamp(expr, timezone: str) -> Column:
    return F.from_utc_timestamp(col(expr), timezone)


def to_utc_timestamp(expr, timezone: str) -> Column:
    return F.to_utc_timestamp(col(expr), timezone)


_UNITS = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 6 * 10**7, "hour": 36 * 10**8, "day": 864 * 10**8, "week": 7 * 864 * 10**8}


def date_trunc(interval: str, expr, relative_to=None) -> Column:
    """Down to a multiple of n units: '1 day', '15 minutes'; weeks start on Monday.

    Multiples count from ``relative_to``, else from 1970 (weeks: from its first Monday).
    """
    n, unit = (interval.split() if " " in interval else ("1", interval))
    n, unit = int(n), unit.rstrip("s")
    if unit in ("month", "quarter", "year"):
        months = n * {"month": 1, "quarter": 3, "year": 12}[unit]
        start = F.lit("1970-01-01").cast("date") if relative_to is None else lit(relative_to).cast("date")
        gone = (F.year(col(expr)) - F.year(start)) * 12 + F.month(col(expr)) - F.month(start)
        return F.add_months(F.trunc(start, "month"), (F.floor(gone / months) * months).cast("int")).cast("timestamp_ntz")
    width = n * _UNITS[unit]
    origin = F.lit(4 * _UNITS["day"] if unit == "week" else 0) if relative_to is None else micros(lit(relative_to))
    return F.timestamp_micros(micros(expr) - F.pmod(micros(expr) - origin, F.lit(width))).cast("timestamp_ntz")


def trunc(expr, interval: str, relative_to=None) -> Column:
    return date_trunc(interval, expr, relative_to)


def to_unix_epoch(expr, time_unit: str = "s") -> Column:
    """Whole units since 1970, cut towards it."""
    per = {"s": 10**6, "ms": 10**3, "us": 1}
    return micros(expr) * 1000 if time_unit == "ns" else F.call_function("div", micros(expr), F.lit(per[time_unit]))


def date_add(expr, days) -> Column:
    return F.date_add(col(expr), lit(days))


def date_sub(expr, days) -> Column:
    return F.date_sub(col(expr), lit(days))


def date_diff(end, start) -> Column:
    return F.datediff(col(end), col(start))


dateadd, datediff = date_add, date_diff


def datepart(part: str, expr) -> Column:
    return F.weekday(col(expr)) if part.lower() in ("dow", "dayofweek", "day_of_week") else F.date_part(F.lit(part), col(expr))


def add_months(expr, months) -> Column:
    return F.add_months(col(expr), lit(months))


def months_between(end, start) -> Column:
    return F.months_between(col(end), col(start), True)


def next_day(expr, day_of_week: str) -> Column:
    return F.next_day(col(expr), day_of_week)


def from_unixtime(expr, format: str = "%Y-%m-%d %H:%M:%S") -> Column:  # noqa: A002
    return F.from_unixtime(col(expr), java_pattern(format))


def make_date(year, month, day) -> Column:
    return F.make_date(col(year), col(month), col(day))


def make_timestamp(year, month, day, hour, minute, second, timezone=None) -> Column:
    cols = list(map(col, (year, month, day, hour, minute, second)))
    return F.make_timestamp_ntz(*cols) if timezone is None else F.make_timestamp(*cols, lit(timezone))


def make_timestamp_ltz(year, month, day, hour, minute, second, timezone=None) -> Column:
    cols = list(map(col, (year, month, day, hour, minute, second)))
    return F.make_timestamp_ltz(*cols) if timezone is None else F.make_timestamp_ltz(*cols, lit(timezone))
