"""Shared parts of linear classifiers over hashed character n-grams.

Labels come from a bounded sample of labelled rows (``sample_rows``, the rows of
least hash of doc_id); counts and active features are computed on executors and
only bounded arrays (one number per bucket; the selected features of the sample)
reach the driver, where the weights are fitted.  Scoring is one pass over all
documents with a table of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkit as tk

BUCKET_BITS = 20
BLOCK_CHARS = 1 << 18


@dataclass(frozen=True)
class Grams:
    """Which character n-grams are features; lower: A-Z count as a-z."""

    orders: tuple[int, ...]
    lower: bool

    def present(self, column: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, bucket) pairs of the texts; with a table only buckets where it isn't 0."""
        raw, offs = tk.flat(column)
        n = int(offs[-1])
        if self.lower:
            raw = tk.LOWER[raw]
        lead = np.zeros(n + 1, np.int64)
        np.cumsum((raw[:n] & 0xC0) != 0x80, out=lead[1:])
        chars = np.frombuffer(raw[:n].tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
        offs = lead[offs]
        owner = np.repeat(np.arange(offs.size - 1, dtype=np.int32), np.diff(offs))
        most, found = max(self.orders), []
        for start in range(0, chars.size, BLOCK_CHARS):  # memory follows the block, also in one long text
            block = chars[start : start + BLOCK_CHARS + most - 1].astype(tk.U)
            row = owner[start : start + BLOCK_CHARS].astype(np.int64)
            room = offs[row + 1] - start
            h = np.zeros(block.size, tk.U)
            for order in range(1, most + 1):
                size = block.size - order + 1
                if size <= 0:
                    break
                h = h[:size] * tk._M3 + block[order - 1 :] + tk.U(1)
                if order not in self.orders:
                    continue
                size = min(size, row.size)
                bucket = ((h[:size] ^ (h[:size] >> tk.U(29))) * tk._M1 >> tk.U(64 - BUCKET_BITS)).astype(np.int64)
                fits = np.arange(size) + order <= room[:size]
                if table is not None:
                    fits &= table[bucket] != 0
                at = np.flatnonzero(fits)
                found.append(np.unique(row[at] << BUCKET_BITS | bucket[at]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str | F.Column, train: F.Column, sample_rows: int) -> DataFrame:
    """text and integer label of at most ``sample_rows`` rows; the label of a doc_id is its largest one.

    The limit after the join holds only where many rows share a labelled doc_id; it takes those of least hash.
    """
    value = (F.col(label) if isinstance(label, str) else label).cast("int")
    chosen = labels.where(train & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), value.alias("label")).where("label is not null")
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")
    again = rows.groupBy("doc_id").count().where("count > 1").limit(1)
    if not again.isEmpty():
        rows = rows.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(sample_rows)
    return rows.select("text", "label").repartition(8)


def bucket_counts(sample: DataFrame, grams: Grams, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class and bucket the number of texts that hold it, and texts per class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros((classes, 1 << BUCKET_BITS), np.int32), np.zeros(classes, np.int64)
        for batch in batches:
            for part in tk.text_slices(batch, limit=1 << 20):
                label = np.clip(part.column("label").to_numpy(zero_copy_only=False), 0, classes - 1)
                texts += np.bincount(label, minlength=classes)
                row, bucket = grams.present(part.column("text"))
                for k in range(classes):
                    counts[k] += np.bincount(bucket[label[row] == k], minlength=1 << BUCKET_BITS).astype(np.int32)
        if texts.any():
            for k in range(classes):
                yield pa.RecordBatch.from_pydict({"k": [k], "texts": [int(texts[k])], "counts": [zlib.compress(counts[k].tobytes(), 1)]})

    total, texts = np.zeros((classes, 1 << BUCKET_BITS), np.int64), np.zeros(classes, np.int64)
    for row in sample.mapInArrow(tk.tidy(run), "k long, texts long, counts binary").collect():  # eight tasks, mostly zeros
        total[row["k"]] += np.frombuffer(zlib.decompress(row["counts"]), np.int32)
        texts[row["k"]] += row["texts"]
    return total, texts


def active_features(sample: DataFrame, grams: Grams, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and for each text the indices of the selected buckets that it holds, one after the other (starts)."""
    table = bucket_table(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.text_slices(batch):
                row, bucket = grams.present(part.column("text"), table)
                index = (table[bucket] - 1).astype(np.int32)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([index[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["label", "on"])

    rows = sample.mapInArrow(tk.tidy(run), "label int, on binary").collect()  # at most sample_rows
    rows.sort(key=lambda r: (r["on"], r["label"]))  # a fixed order, so that fits agree to the last bit
    on = [np.frombuffer(r["on"], np.int32) for r in rows]
    starts = np.append(0, np.cumsum([x.size for x in on]))
    return np.array([r["label"] for r in rows], np.int64), np.concatenate([*on, np.zeros(0, np.int32)]), starts


def bucket_table(buckets: np.ndarray) -> np.ndarray:
    """Index + 1 of each selected bucket, else 0."""
    table = np.zeros(1 << BUCKET_BITS, np.int16)
    table[buckets] = np.arange(1, buckets.size + 1)
    return table


def descend(gradient: Callable[[np.ndarray], np.ndarray], x: np.ndarray, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Adam with a decaying rate."""
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x


def sums(on: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(weights[on]))
    return total[starts[1:]] - total[starts[:-1]]


def linear_scores(docs: DataFrame, grams: Grams, buckets: np.ndarray, weights: np.ndarray, finish: Callable[[np.ndarray], list[pa.Array]], names: list[str], schema: str) -> DataFrame:
    """doc_id and what ``finish`` makes of the sum of weights of each document; the table that ships has a fixed size."""
    shipped = docs.sparkSession.sparkContext.broadcast((bucket_table(buckets), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, w = shipped.value
        for batch in batches:
            for part in tk.text_slices(batch, limit=1 << 20):
                row, bucket = grams.present(part.column("text"), table)
                total = np.bincount(row, w[table[bucket] - 1], part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *finish(total)], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tk.tidy(run), schema)


def held_out_rows() -> F.Column:
    """Rows whose crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
