"""Writers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def write_files(df: DataFrame, path: str, fmt: str, write_mode: str = "append", partition_cols=(), single_file: bool = False, **options) -> DataFrame:
    """Write and return the paths below ``path``; mode append, overwrite or overwrite-partitions."""
    out = (df.coalesce(1) if single_file else df).write.format(fmt).options(**options)
    if write_mode == "overwrite-partitions":
        out = out.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    else:
        out = out.mode(write_mode)
    out.partitionBy(*partition_cols).save(path)
    return df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


class Sink:
    """A user's sink: ``start`` on the driver, ``write`` for each task's Arrow batches, ``finalize`` with what the tasks returned.

    Only what a task's committed attempt returned reaches ``finalize``; of a task
    that ran again or twice the other attempts' results go to ``discard``.  What
    ``write`` stores should carry a name of its attempt (``pyspark.TaskContext``).
    """

    def start(self) -> None: ...

    def write(self, batches: Iterator) -> Iterator[dict]:
        raise NotImplementedError

    def finalize(self, results: list[dict]) -> list[dict]:
        return results

    def discard(self, results: list[dict]) -> None: ...

    def schema(self) -> str:
        return "rows long"


@dataclass
class _Wrote(WriterCommitMessage):
    results: list


class _SinkWriter(DataSourceArrowWriter):
    def __init__(self, sink: Sink, path: str):
        self.sink, self.path = sink, path

    def write(self, batches: Iterator) -> _Wrote:
        return _Wrote(list(self.sink.write(batches)))

    def _results(self, messages: list) -> list[dict]:
        return [r for m in messages if m is not None for r in m.results]

    def commit(self, messages: list) -> None:
        import pickle

        with open(self.path, "wb") as f:  # on the driver's own disk, which reads it at once
            pickle.dump(self.sink.finalize(self._results(messages)), f)

    def abort(self, messages: list) -> None:
        self.sink.discard(self._results(messages))


def write_sink(df: DataFrame, sink: Sink) -> DataFrame:
    """Write by Spark's own commit protocol for data sources; returns what ``finalize`` gives."""
    import os
    import pickle
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        path = os.path.join(folder, "results")

        class ToSink(DataSource):
            @classmethod
            def name(cls) -> str:
                return "loom_sink"

            def schema(self) -> str:
                return "rows long"

            def writer(self, schema, overwrite):
                return _SinkWriter(sink, path)

        df.sparkSession.dataSource.register(ToSink)
        sink.start()
        df.write.format("loom_sink").mode("append").save()
        with open(path, "rb") as f:
            results = pickle.load(f)  # noqa: S301
    return df.sparkSession.createDataFrame(results, sink.schema())


def unseen(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in a table of processed keys."""
    return df.join(done.select(F.col(key)).distinct(), key, "left_anti")


class CheckpointStore:
    """Keys of rows that earlier runs have processed, as Parquet below a shared folder.

    A run reads what is ``unseen``, writes its results, stages the keys it took
    (``stage``) and then commits them by name, one rename.  A run that fails
    before leaves staged keys that nobody reads, so its rows come again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *names: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def runs(self) -> list[str]:
        fs, done = self._at("done")
        return sorted(x.getPath().getName() for x in fs.listStatus(done)) if fs.exists(done) else []

    def unseen(self, df: DataFrame, key: str) -> DataFrame:
        """Null keys are never seen."""
        paths = [f"{self.path}/done/{r}" for r in self.runs()]
        return unseen(df, self.spark.read.parquet(*paths), key) if paths else df

    def stage(self, df: DataFrame, key: str, run: str) -> None:
        df.select(key).where(F.col(key).isNotNull()).distinct().write.mode("overwrite").parquet(f"{self.path}/staged/{run}")

    def commit(self, run: str) -> None:
        fs, done = self._at("done")
        fs.mkdirs(done)
        staged, to = self._at("staged", run)[1], self._at("done", run)[1]
        if not fs.exists(staged) or fs.exists(to) or not fs.rename(staged, to):
            raise OSError(f"run {run} wasn't staged, or is there already")
