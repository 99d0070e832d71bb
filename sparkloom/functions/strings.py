"""Strings and JSON.  Places start at 0, and a pattern that isn't found gives null."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col, lit, rename

rename({"lower": F.lower, "upper": F.upper, "reverse": F.reverse, "length_bytes": F.octet_length, "soundex": F.soundex, "ascii_func": F.ascii, "chr_func": F.char, "json_array_length": F.json_array_length, "json_object_keys": F.json_object_keys, "serialize": F.to_json}, globals())


def lstrip(expr) -> Column:
    return F.regexp_replace(col(expr), r"^\s+", "")


def rstrip(expr) -> Column:
    return F.regexp_replace(col(expr), r"\s+$", "")


def strip(expr) -> Column:
    return F.regexp_replace(col(expr), r"^\s+|\s+$", "")


def capitalize(expr) -> Column:
    c = col(expr)
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, F.lit(2), F.char_length(c))))


def case_words(expr) -> Column:
    """Words of an identifier: cut at other characters, before capitals that follow small ones, and before the last of several capitals."""
    c = F.regexp_replace(col(expr), r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    c = F.regexp_replace(c, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _cased(expr, each, joint: str) -> Column:
    return F.array_join(F.transform(case_words(expr), each), joint)


def to_snake_case(expr) -> Column:
    return _cased(expr, F.lower, "_")


def to_upper_snake_case(expr) -> Column:
    return _cased(expr, F.upper, "_")


def to_kebab_case(expr) -> Column:
    return _cased(expr, F.lower, "-")


def to_upper_kebab_case(expr) -> Column:
    return _cased(expr, F.upper, "-")


def to_title_case(expr) -> Column:
    return _cased(expr, capitalize, " ")


def to_upper_camel_case(expr) -> Column:
    return _cased(expr, capitalize, "")


def to_camel_case(expr) -> Column:
    out = to_upper_camel_case(expr)
    first = F.lower(F.element_at(F.concat(case_words(expr), F.array(F.lit(""))), 1))
    return F.concat(first, F.substring(out, F.char_length(first) + 1, F.char_length(out)))


def left(expr, nchars) -> Column:
    return F.left(col(expr), lit(nchars))


def right(expr, nchars) -> Column:
    return F.right(col(expr), lit(nchars))


def lpad(expr, length, pad: str) -> Column:
    return F.lpad(col(expr), length, pad)


def rpad(expr, length, pad: str) -> Column:
    return F.rpad(col(expr), length, pad)


def repeat(expr, n) -> Column:
    return F.repeat(col(expr), lit(n))


def space(expr) -> Column:
    return F.repeat(F.lit(" "), col(expr))


def contains(expr, substr) -> Column:
    return col(expr).contains(lit(substr))


def startswith(expr, prefix) -> Column:
    return col(expr).startswith(lit(prefix))


def endswith(expr, suffix) -> Column:
    return col(expr).endswith(lit(suffix))


def like(expr, pattern: str) -> Column:
    return col(expr).like(pattern)


def ilike(expr, pattern: str) -> Column:
    return col(expr).ilike(pattern)


def substr(expr, start, length=None) -> Column:
    c = col(expr)
    return F.substring(c, lit(start) + 1, F.char_length(c) if length is None else lit(length))


def find(expr, substr) -> Column:
    """Where a string begins in another; -1 where it doesn't."""
    return F.instr(col(expr), lit(substr)) - 1


def split(expr, split_on: str) -> Column:
    """At a literal separator."""
    return F.split(col(expr), re.escape(split_on) if split_on else "")


def regexp(expr, pattern: str) -> Column:
    return col(expr).rlike(pattern)


def regexp_count(expr, pattern: str) -> Column:
    return F.regexp_count(col(expr), F.lit(pattern))


def regexp_extract(expr, pattern: str, index: int = 0) -> Column:
    return F.when(col(expr).rlike(pattern), F.regexp_extract(col(expr), pattern, index))


def regexp_extract_all(expr, pattern: str, index: int = 0) -> Column:
    return F.regexp_extract_all(col(expr), F.lit(pattern), index)


def regexp_split(expr, pattern: str) -> Column:
    return F.split(col(expr), pattern)


def regexp_replace(expr, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col(expr), pattern, replacement)


def replace(expr, search, replacement) -> Column:
    return F.replace(col(expr), lit(search), lit(replacement))


def translate(expr, from_str: str, to_str: str) -> Column:
    return F.translate(col(expr), from_str, to_str)


def substring_index(expr, delim: str, count: int) -> Column:
    return F.substring_index(col(expr), delim, count)


def split_part(expr, delim, part) -> Column:
    return F.split_part(col(expr), lit(delim), lit(part))


def concat_ws(sep: str, *exprs) -> Column:
    """Nulls are left out; null where all are."""
    cols = list(map(col, exprs))
    return F.when(F.coalesce(*cols).isNotNull(), F.concat_ws(sep, *cols))


def format(f_string: str, *args) -> Column:  # noqa: A001
    """Put the arguments in the places of ``{}``."""
    parts = f_string.split("{}")
    if len(parts) != len(args) + 1:
        raise ValueError(f"{len(parts) - 1} places for {len(args)} arguments")
    out = [F.lit(parts[0])]
    for a, p in zip(args, parts[1:], strict=True):
        out += [col(a).cast("string"), F.lit(p)]
    return F.concat(*out)


def count_matches(expr, patterns: list[str], whole_words: bool = False, case_sensitive: bool = True) -> Column:
    """How often any of several literal strings occurs."""
    some = "|".join(re.escape(p) for p in sorted(patterns, key=len, reverse=True))
    if not some:
        return F.when(col(expr).isNotNull(), F.lit(0))
    return F.regexp_count(col(expr), F.lit(("" if case_sensitive else "(?i)") + (rf"\b(?:{some})\b" if whole_words else some)))


def normalize(expr, remove_punct: bool = False, lowercase: bool = False, nfd_unicode: bool = False, white_space: bool = False) -> Column:
    c = col(expr)
    if nfd_unicode:

        @F.pandas_udf("string")
        def nfd(s: pd.Series) -> pd.Series:
            return s.str.normalize("NFD")

        c = nfd(c)
    c = F.lower(c) if lowercase else c
    c = F.regexp_replace(c, r"[\p{Punct}]", "") if remove_punct else c
    return F.trim(F.regexp_replace(c, r"\s+", " ")) if white_space else c


def deserialize(expr, dtype: str) -> Column:
    """JSON text to a type; raises where it can't be read."""
    return F.from_json(col(expr), dtype, {"mode": "FAILFAST"})


def try_deserialize(expr, dtype: str) -> Column:
    return F.from_json(col(expr), dtype)


def jq(expr, filter: str) -> Column:  # noqa: A002
    """Plain paths such as ``.a.b[0]``."""
    if not re.fullmatch(r"\.|(\.\w+|\[\d+\]|\.\[\d+\])+", filter):
        raise NotImplementedError(f"only plain paths: {filter}")
    path = "$" if filter == "." else "$" + filter.replace(".[", "[")
    return F.get_json_object(col(expr), path)


def json_tuple(expr, *fields: str) -> Column:
    return F.struct(*(F.get_json_object(col(expr), f"$.{f}").alias(f) for f in fields))


def levenshtein_distance(left, right) -> Column:
    return F.levenshtein(col(left), col(right))


def hamming_distance_str(left, right) -> Column:
    """Places where two strings of one length differ; null for others."""
    a, b = col(left), col(right)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.char_length(a) == F.char_length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(mine, (y for y, u in zip(b, used, strict=True) if u), strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _jaro_winkler(a: str, b: str) -> float:
    base, same = _jaro(a, b), 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return base + 0.1 * same * (1 - base)


def _damerau(a: str, b: str) -> int:
    """Restricted edits: insertions, deletions, changes and swaps of neighbours."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def _pairwise(f, kind: str):
    def of(left, right) -> Column:
        @F.pandas_udf(kind)
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return run(col(left), col(right))

    return of


jaro_similarity = _pairwise(_jaro, "double")
jaro_winkler_similarity = _pairwise(_jaro_winkler, "double")
damerau_levenshtein_distance = _pairwise(_damerau, "long")
jaro_similarity.__doc__ = "Jaro similarity of two strings."
jaro_winkler_similarity.__doc__ = "Jaro-Winkler similarity with a prefix of up to four."
damerau_levenshtein_distance.__doc__ = "Edits with swaps of neighbours."


def tokenize_encode(expr, tokens_path: str, pattern: str | None = None) -> Column:
    """Token ids by a vocabulary file of base64 tokens and ranks: a path that every executor has, or the name of a file added by ``addFile``."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series) -> pd.Series:
        enc = _encoding(tokens_path, pattern)
        return pd.Series([None if x is None else enc.encode_ordinary(x) for x in s])

    return run(col(expr))


def tokenize_decode(expr, tokens_path: str, pattern: str | None = None) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        enc = _encoding(tokens_path, pattern)
        return pd.Series([None if x is None else enc.decode(list(x)) for x in s])

    return run(col(expr))


_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict = {}


def _encoding(path: str, pattern: str | None):
    import base64
    import os

    import tiktoken
    from pyspark import SparkFiles

    if (path, pattern) not in _encodings:
        where = path if os.path.exists(path) else SparkFiles.get(path)
        with open(where, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("file", pat_str=pattern or _PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def parse_url(expr) -> Column:
    """scheme, host, path, query, fragment and more of a URL, null for what isn't one."""
    parts = {"scheme": "PROTOCOL", "authority": "AUTHORITY", "host": "HOST", "path": "PATH", "query": "QUERY", "fragment": "REF", "userinfo": "USERINFO"}
    return F.struct(*(F.try_parse_url(col(expr), F.lit(p)).alias(n) for n, p in parts.items()))
