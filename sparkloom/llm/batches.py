"""Documents in batches that later passes can find again.

A batch is one row (bid, rows): some tens of megabytes of documents as one
compressed Arrow stream, written once to the shared folder.  Passes that need
answers about a batch's contents (a count for each of its words, say) send
its distinct keys once, however often they occur in it, and get the answers
back by bid: a key that a third of all documents hold costs one entry a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkloom.llm import textkit as tk
from sparkloom.llm.shared import saved

BATCH_BYTES = 16 << 20
#: Parquet looks at a page's size every 100 rows, which of these are many megabytes; its codecs take direct memory for a whole page.
SMALL_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as source:
        table = source.read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)


def batch_table(docs: DataFrame, name: str, batch_bytes: int = BATCH_BYTES, **options: str) -> DataFrame:
    """(bid, rows) of all documents with all their columns, written with ``options``; needs a column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, seq = TaskContext.get().partitionId(), [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | seq]), pa.array([to_bytes(pa.Table.from_batches(held))], pa.binary())], ["bid", "rows"])

        for batch in batches:
            for part in tk.text_slices(batch, limit=batch_bytes // 4):
                held.append(part)
                size += part.nbytes
                if size >= batch_bytes:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return saved(docs.mapInArrow(tk.tidy(run), "bid long, rows binary"), name, **options)


def answered(batches: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
    """f(bid, documents, answers as a table) for each batch; answers has a column bid and may lack batches."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        tk.release()
        out = [f(left.column("bid")[k].as_py(), from_bytes(left.column("rows")[k].as_py()), right) for k in range(left.num_rows)]
        return pa.concat_tables([x for one in out for x in one]) if any(out) else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    empty = pa.Table.from_arrays([pa.array([], x.type) for x in arrow], schema=arrow)
    return batches.groupBy("bid").cogroup(answers.groupBy("bid")).applyInArrow(run, schema)


def doc_slices(docs: pa.RecordBatch, column: str = "text", limit: int = tk.SLICE_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of bounded bytes, with the row each starts at."""
    row = 0
    for part in tk.text_slices(docs, column, limit):
        yield row, part
        row += part.num_rows


def by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted hashes: the shards that occur (by value range) and the bounds of each."""
    shard = (hashes >> np.uint64(32)).astype(np.int64) * shards >> 32
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    return shard[cuts], np.append(cuts, hashes.size)
