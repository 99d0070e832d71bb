"""What a run of a plan left behind: its operators' metrics, and files that couldn't be read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _inner(node) -> list:
    """The operators below one of the executed plan, through adaptive stages, reused exchanges and caches."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    if kind == "InMemoryTableScanExec":
        return [node.relation().cachedPlan()]
    children = node.children()
    return [children.apply(k) for k in range(children.size())]


def metrics(df: DataFrame) -> list[tuple[int, str, str, int]]:
    """(number from the plan's root, operator, metric, value) of a cached frame's run; sizes and times summed over tasks."""
    out, todo, number = [], [df.select("*")._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        entries = node.metrics().iterator()
        while entries.hasNext():
            entry = entries.next()
            out.append((number, node.nodeName(), entry._1(), max(0, int(entry._2().value()))))
        todo += reversed(_inner(node))
        number += 1
    return out


def _fault(path: str) -> tuple[str, bool] | None:
    """Why a file can't be read to its end, and whether rows came before that; None where it can."""
    from sparkloom.functions.media import open_path

    some = False
    try:
        system, at = open_path(path)
        if path.endswith(".parquet"):
            import pyarrow.parquet as pq

            with system.open_input_file(at) as file:
                for _ in pq.ParquetFile(file).iter_batches():
                    some = True
        else:
            with system.open_input_stream(at, compression="detect") as file:
                while file.read(1 << 20):
                    some = True
    except Exception as e:  # whatever a codec raises is the finding
        return f"{type(e).__name__}: {e}", some
    return None


def _files(df: DataFrame) -> list[str]:
    """The files that a frame reads, cached or not (``inputFiles`` doesn't look below a cache)."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            out |= set(leaf.relation().inputFiles())
    return sorted(out)


def unreadable(df: DataFrame) -> list[tuple[str, str, bool]]:
    """The faults among a frame's files, one task for a share of the paths; the driver gets only faulty ones."""
    paths = _files(df)
    if not paths:
        return []
    spark = df.sparkSession

    def check(frames: Iterator) -> Iterator:
        import pandas as pd

        for paths in frames:
            found = [(p, *f) for p in paths["path"] if (f := _fault(p))]
            yield pd.DataFrame(found, columns=["path", "reason", "partial"])

    dealt = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 8 * spark.sparkContext.defaultParallelism), F.col("path"))
    return sorted((r["path"], r["reason"], r["partial"]) for r in dealt.mapInPandas(check, "path string, reason string, partial boolean").toLocalIterator())
