"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (table, spark, sf_dir): ``table(name)`` reads a table of sf_dir."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(c: Column, digits: int) -> Column:
    """Doubles rounded as SQL does it: what is below 0 and rounds to it keeps its sign (-0.0), which Spark drops."""
    out = F.round(c, digits)
    return F.when((out == 0) & (c < 0), F.lit(-0.0)).otherwise(out)


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores, several parts for each: for small files whose rows take long, which Spark reads in few parts."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
