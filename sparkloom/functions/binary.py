"""Encodings and compression."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col


def encode(expr, charset: str = "utf-8") -> Column:
    if charset == "base64":
        return F.base64(col(expr)).cast("binary")
    return F.hex(col(expr)).cast("binary") if charset == "hex" else F.encode(col(expr), charset)


def decode(expr, charset: str = "utf-8") -> Column:
    if charset == "base64":
        return F.unbase64(col(expr).cast("string"))
    return F.unhex(col(expr).cast("string")) if charset == "hex" else F.decode(col(expr), charset)


def try_encode(expr, charset: str = "utf-8") -> Column:
    return F.when(F.is_valid_utf8(col(expr)), encode(expr, charset))


def try_decode(expr, charset: str = "utf-8") -> Column:
    return F.try_validate_utf8(col(expr).cast("string")) if charset == "utf-8" else F.try_to_binary(col(expr).cast("string"), F.lit(charset))


_PACK = {"gzip": lambda b: gzip.compress(b, mtime=0), "zlib": zlib.compress, "deflate": lambda b: zlib.compress(b)[2:-4]}
_UNPACK = {"gzip": gzip.decompress, "zlib": zlib.decompress, "deflate": lambda b: zlib.decompress(b, -15)}


def _mapped(expr, f, soft: bool) -> Column:
    def one(b):
        try:
            return f(b.encode() if isinstance(b, str) else bytes(b))
        except Exception:
            if soft:
                return None
            raise

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else one(b))

    return run(col(expr))


def compress(expr, codec: str = "zlib") -> Column:
    return _mapped(expr, _PACK[codec], False)


def decompress(expr, codec: str = "zlib") -> Column:
    return _mapped(expr, _UNPACK[codec], False)


def try_compress(expr, codec: str = "zlib") -> Column:
    return _mapped(expr, _PACK[codec], True)


def try_decompress(expr, codec: str = "zlib") -> Column:
    return _mapped(expr, _UNPACK[codec], True)
