"""User functions: by row, by batch, stateful classes, generators and aggregates."""

from __future__ import annotations

import asyncio
import functools
import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions._base import col


def _guarded(f: Callable, on_error: str, retries: int) -> Callable:
    @functools.wraps(f)
    def run(*args):
        for attempt in range(retries + 1):
            try:
                return f(*args)
            except Exception:
                if attempt == retries:
                    if on_error == "raise":
                        raise
                    return None

    return run


def func(return_dtype: str, on_error: str = "raise", max_retries: int = 0, max_concurrency: int = 32):
    """By row: plain functions as Arrow UDFs, generators as list columns to explode,
    coroutines concurrently within each batch."""

    def put(f: Callable):
        if inspect.iscoroutinefunction(f):

            async def one(sem, row):
                async with sem:
                    for attempt in range(max_retries + 1):
                        try:
                            return await f(*row)
                        except Exception:
                            if attempt == max_retries:
                                if on_error == "raise":
                                    raise
                                return None

            async def every(rows):
                sem = asyncio.Semaphore(max_concurrency)
                return await asyncio.gather(*(one(sem, r) for r in rows))

            @F.pandas_udf(return_dtype)
            def batch(*cols: pd.Series) -> pd.Series:
                return pd.Series(asyncio.run(every(list(zip(*cols, strict=True)))))

            return lambda *args: batch(*map(col, args))
        if inspect.isgeneratorfunction(f):
            run = F.udf(_guarded(lambda *a: list(f(*a)), on_error, max_retries), f"array<{return_dtype}>", useArrow=True)
        else:
            run = F.udf(_guarded(f, on_error, max_retries), return_dtype, useArrow=True)
        return lambda *args: run(*map(col, args))

    return put


def batch(return_dtype: str, batch_size: int | None = None):
    """By batch: pandas series in, one out; with ``batch_size`` of that many rows at most."""

    def put(whole: Callable):
        def f(*cols):
            if batch_size is None or len(cols[0]) <= batch_size:
                return whole(*cols)
            return pd.concat([whole(*(c.iloc[k : k + batch_size] for c in cols)) for k in range(0, len(cols[0]), batch_size)])

        def many(batches: Iterator[tuple]) -> Iterator[pd.Series]:
            for cols in batches:
                yield f(*cols)

        def on(*args) -> Column:
            if len(args) == 1:

                @F.pandas_udf(return_dtype)
                def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                    for s in batches:
                        yield f(s)

                return one(col(args[0]))

            @F.pandas_udf(return_dtype)
            def several(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
                yield from many(batches)

            return several(*map(col, args))

        return on

    return put


def stateful(cls: type, return_dtype: str, method: str = "__call__", **init) -> Callable:
    """A class that each task makes once; its method takes and gives pandas series."""

    def on(expr) -> Column:
        @F.pandas_udf(return_dtype)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            made = cls(**init)
            for s in batches:
                yield getattr(made, method)(s)

        return run(col(expr))

    return on


class Aggregate:
    """A user's aggregate in two steps: ``aggregate(pandas frame) -> state dict`` in each
    partition, ``combine(states frame) -> state dict`` after one shuffle of states, ``finalize(state)``."""

    state: str
    result: str

    def aggregate(self, rows: pd.DataFrame) -> dict:
        raise NotImplementedError

    def combine(self, states: pd.DataFrame) -> dict:
        raise NotImplementedError

    def finalize(self, state: dict):
        raise NotImplementedError


def aggregate(df, agg: Aggregate, keys: list[str], name: str = "result"):
    """keys and the aggregate's result; rows of a key meet as states only."""
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [dict(zip(keys, k, strict=True)) | agg.aggregate(g) for k, g in rows.groupby(keys, dropna=False)]
            if out:
                yield pd.DataFrame(out)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{k: rows[k].iloc[0] for k in keys} | {name: agg.finalize(agg.combine(rows))}])

    states = df.mapInPandas(partial, f"{head}, {agg.state}")
    return states.groupBy(*keys).applyInPandas(merge, f"{head}, `{name}` {agg.result}")
