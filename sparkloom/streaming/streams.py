"""Streams of files, windowed aggregates with a watermark, and a sink that can be read as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, schema: str, file_format: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    """New files below ``path`` as they come; a bound of files keeps a first run over a large folder in steps."""
    out = spark.readStream.format(file_format).schema(schema).options(**options)
    return (out.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else out).load(path)


def windowed(stream: DataFrame, time: str, width: str, keys: list[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Aggregates by time window and keys: start, end, keys and the aggregates.

    With ``late`` rows later than that are dropped and windows before it are
    closed, which bounds the state; without it the state holds every window, as
    a sink needs that rewrites all of its rows.
    """
    rows = stream.withWatermark(time, late) if late else stream
    out = rows.groupBy(F.window(time, width).alias("__w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("__w.start").alias("start"), F.col("__w.end").alias("end"), *keys, *aggregates)


def write_stream(stream: DataFrame, path: str, state: str, table: str, mode: str = "complete") -> None:
    """Run over all there is: each trigger's rows replace (complete, update) or extend (append) ``path``, which ``table`` names as a view.

    ``state`` keeps offsets and aggregates, so that a later run goes on where this one ended.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("append" if mode == "append" else "overwrite").parquet(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    stream.sparkSession.read.parquet(path).createOrReplaceTempView(table)
