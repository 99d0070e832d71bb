"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_mine: list[tuple[object, object]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of this machine only where all of Spark runs in this process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return root or "file:///tmp/checkpoints/sparkloom"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = fs.makeQualified(target)
    _mine.append((fs, target))
    return target.toString()


@atexit.register
def _clean() -> None:
    for fs, target in _mine:
        try:
            fs.delete(target, True)
        except Exception:  # the JVM may be gone
            return


def saved(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and lost executors cost nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    gone = {df.__dict__.get("_saved_at") for df in tables} - {None}
    for fs, target in [x for x in _mine if x[1].toString() in gone]:
        fs.delete(target, True)
    _mine[:] = [x for x in _mine if x[1].toString() not in gone]


def input_bytes(df: DataFrame) -> int:
    """Size of a table that was read from files (of others the optimiser knows nothing)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it (case aside, as Spark resolves names)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
