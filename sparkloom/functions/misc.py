"""Conversions, nulls, maps, structs and hashes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, types
from pyspark.sql import functions as F

from sparkloom.functions._base import col, lit, rename

rename({"map_keys": F.map_keys, "map_values": F.map_values}, globals())
monotonically_increasing_id = F.monotonically_increasing_id


def cast(expr, dtype) -> Column:
    return col(expr).cast(dtype)


def try_cast(expr, dtype) -> Column:
    return col(expr).try_cast(dtype)


def is_null(expr) -> Column:
    return col(expr).isNull()


def not_null(expr) -> Column:
    return col(expr).isNotNull()


def fill_null(expr, fill_value) -> Column:
    return F.coalesce(col(expr), lit(fill_value))


def coalesce(*args) -> Column:
    return F.coalesce(*map(col, args))


def is_in(expr, other) -> Column:
    return col(expr).isin(*other)


def eq_null_safe(left, right) -> Column:
    return col(left).eqNullSafe(col(right))


def when(condition: Column, then) -> Column:
    return F.when(condition, lit(then))


def concat(left, right) -> Column:
    return F.concat(col(left), col(right))


def get(expr, key, default=None) -> Column:
    """A list's element by its place (negative: from the end), a struct's field by name."""
    if isinstance(key, str):
        out = col(expr).getField(key)
    elif isinstance(key, int):
        out = F.try_element_at(col(expr), F.lit(key + 1 if key >= 0 else key))
    else:
        out = F.try_element_at(col(expr), F.when(key >= 0, key + 1).otherwise(key).cast("int"))
    return out if default is None else F.coalesce(out, lit(default))


def map_get(expr, key) -> Column:
    return F.try_element_at(col(expr), lit(key))


def to_struct(*fields) -> Column:
    return F.struct(*map(col, fields))


def unnest(expr: str) -> Column:
    """All fields of a struct column, for ``select``."""
    return F.col(f"{expr}.*")


def length(expr, of: str | types.DataType = "string") -> Column:
    """Characters of strings, bytes of binaries, elements of lists and maps."""
    kind = of if isinstance(of, str) else of.typeName()
    return F.octet_length(col(expr)) if kind == "binary" else F.when(col(expr).isNotNull(), F.size(col(expr))) if kind in ("array", "map") else F.char_length(col(expr))


def uuid(version: int = 4) -> Column:
    """Random (4), or led by the time in milliseconds (7)."""
    if version == 4:
        return F.uuid()
    time = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    tail = F.uuid()
    return F.concat(F.substring(time, 1, 8), F.lit("-"), F.substring(time, 9, 4), F.lit("-7"), F.substring(tail, 16, 21))


def random_int(low: int, high: int, seed: int | None = None) -> Column:
    """low..high-1."""
    return (F.floor((F.rand(seed) if seed is not None else F.rand()) * (high - low)) + low).cast("long")


def hash(*exprs, seed: int = 42, hash_function: str = "xxhash64") -> Column:  # noqa: A001
    """A 64-bit (xxhash64) or 32-bit (murmur3) hash; another seed is mixed in as a first value."""
    cols = [*([] if seed == 42 else [F.lit(seed)]), *map(col, exprs)]
    return F.xxhash64(*cols) if hash_function.startswith("xx") else F.hash(*cols)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once; Spark computes what a lambda function captures again for each element."""
    return F.transform(F.array(value), f)[0]


def word_ngrams(text, size: int) -> Column:
    """Runs of ``size`` words; of shorter texts the whole."""

    def grams(words: Column) -> Column:
        n = F.size(words)
        return F.when(n >= size, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))).otherwise(F.array(F.array_join(words, " ")))

    return _bound(F.split(F.trim(F.regexp_replace(col(text), r"\s+", " ")), " "), grams)


def minhash(text, num_hashes: int = 16, ngram_size: int = 1, seed: int = 1) -> Column:
    """The least hash of the text's word n-grams under each of ``num_hashes`` seeds."""
    least = lambda grams: F.transform(F.sequence(F.lit(seed), F.lit(seed + num_hashes - 1)), lambda s: F.array_min(F.transform(grams, lambda g: F.xxhash64(s, g))))
    return F.when(col(text).isNotNull(), _bound(word_ngrams(text, ngram_size), least))


#: characters whose n-grams are counted at a time, and n-grams whose hashes are kept for later texts
_SIMHASH_CHARS, _SIMHASH_KEPT = 1 << 16, 1 << 17


class _Hashes(dict):
    """XXH64 by string."""

    def __missing__(self, gram: str) -> int:
        from xxhash import xxh64_intdigest

        out = xxh64_intdigest(gram.encode(), 42)
        if len(self) < _SIMHASH_KEPT:
            self[gram] = out
        return out


def _simhash(text: str, size: int, hashes: _Hashes) -> int:
    n = max(len(text) - size + 1, 1)
    ones = np.zeros(64)
    for start in range(0, n, _SIMHASH_CHARS):
        part = text[start : min(start + _SIMHASH_CHARS, n) + size - 1]
        counts = Counter(map("".join, zip(*(part[k:] for k in range(size)), strict=False)) if len(part) > size else [part])
        found = np.fromiter(map(hashes.__getitem__, counts), "<u8", len(counts))
        bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.fromiter(counts.values(), np.float32, len(counts)) @ bits.astype(np.float32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def simhash(text, ngram_size: int = 3) -> Column:
    """64 bits, each the majority of that bit over the hashes (Spark's xxhash64) of all character n-grams."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = _Hashes()
        for s in batches:
            yield pd.Series([None if t is None else _simhash(t, ngram_size, hashes) for t in s], dtype="Int64")

    return run(col(text))
