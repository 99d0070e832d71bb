"""Partition transforms of table formats, and times inside version 7 UUIDs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col
from sparkloom.functions.temporal import micros


def partition_days(expr) -> Column:
    return F.to_date(col(expr))


def partition_hours(expr) -> Column:
    return F.floor(micros(expr) / 3_600_000_000).cast("int")


def partition_months(expr) -> Column:
    return (F.year(col(expr)) - 1970) * 12 + F.month(col(expr)) - 1


def partition_years(expr) -> Column:
    return F.year(col(expr)) - 1970


def _murmur(data: bytes) -> int:
    h, n = 0, len(data)
    words = np.frombuffer(data[: n // 4 * 4], "<u4").tolist()
    tail = int.from_bytes(data[n // 4 * 4 :], "little")

    def scramble(k: int) -> int:
        k = k * 0xCC9E2D51 & 0xFFFFFFFF
        return (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF

    for k in words:
        h ^= scramble(k)
        h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= scramble(tail) if n % 4 else 0
    h ^= n
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * by & 0xFFFFFFFF
    return h ^ h >> 16


def partition_iceberg_bucket(expr, n: int) -> Column:
    """Murmur3 (32 bits, seed 0) of an integer's eight bytes or of a string, modulo n."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        one = lambda v: _murmur(v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, (bytes, bytearray)) else int(v).to_bytes(8, "little", signed=True))
        return pd.Series([None if v is None or v != v else (one(v) & 0x7FFFFFFF) % n for v in s], dtype="Int32")

    return run(col(expr))


def partition_iceberg_truncate(expr, w: int, text: bool = False) -> Column:
    """Integers down to a multiple of w; texts to their first w characters."""
    return F.left(col(expr), F.lit(w)) if text else col(expr) - F.pmod(col(expr), F.lit(w))


def _uuid_millis(expr) -> Column:
    return F.conv(F.left(F.replace(col(expr), F.lit("-"), F.lit("")), F.lit(12)), 16, 10).cast("long")


def extract_minute_uuid7(expr) -> Column:
    return F.floor(_uuid_millis(expr) / 60_000).cast("long")


def extract_hour_uuid7(expr) -> Column:
    return F.floor(_uuid_millis(expr) / 3_600_000).cast("long")


def extract_day_uuid7(expr) -> Column:
    return F.floor(_uuid_millis(expr) / 86_400_000).cast("long")


def extract_month_uuid7(expr) -> Column:
    """Months since 1970 in UTC, whatever the session's time zone."""
    return partition_months(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(_uuid_millis(expr) / 86_400_000).cast("int")))
