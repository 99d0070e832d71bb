"""Model calls over text and images, through providers registered by name.

A provider is a class with the methods below; each task makes one instance and
feeds it whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions._base import col

_providers: dict[str, Callable] = {}


def register_provider(name: str, make: Callable) -> None:
    """``make()`` gives an object with any of embed(list), classify(list, labels), generate(list)."""
    _providers[name] = make


def _batched(expr, provider: str, schema: str, call) -> Column:
    if provider not in _providers:
        raise ValueError(f"no provider {provider!r}; register one")
    make = _providers[provider]

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for s in batches:
            full = s[s.notna()]
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if len(full):
                for k, v in zip(full.index, call(client, list(full)), strict=True):
                    out[k] = v
            yield out

    return run(col(expr))


def embed_text(text, provider: str) -> Column:
    return _batched(text, provider, "array<float>", lambda c, x: c.embed(x))


embed_image = embed_text


def classify_text(text, labels: list[str], provider: str) -> Column:
    return _batched(text, provider, "string", lambda c, x: c.classify(x, labels))


classify_image = classify_text


def prompt(messages, provider: str) -> Column:
    return _batched(messages, provider, "string", lambda c, x: c.generate(x))


llm_generate = prompt


def prompt_by_prefix(df: DataFrame, messages: str, provider: str, name: str = "output") -> DataFrame:
    """``prompt`` with like prompts side by side, for providers that reuse the work on a common prefix.
    Ranges of prompts make the partitions; equal prompts spread over them by a hash of the whole row."""
    spread = F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in df.columns))
    ordered = df.repartitionByRange(F.col(messages), spread).sortWithinPartitions(messages)
    return ordered.withColumn(name, prompt(messages, provider))


def run_process(args, on_error: str = "raise") -> Column:
    """Standard output of a command, given as a list column."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        import subprocess

        def one(a):
            try:
                return subprocess.run(list(a), capture_output=True, text=True, check=True, timeout=600).stdout
            except Exception:
                if on_error == "raise":
                    raise
                return None

        return s.map(lambda a: None if a is None else one(a))

    return run(col(args))
