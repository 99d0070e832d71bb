"""Packing token sequences into windows by minimum bin slack.

A document fills whole windows with its first tokens; its rest, below a window,
joins a multiset of lengths.  Only the counts of lengths (at most ``window``
numbers, however many documents there are) go to the driver.  There each window
takes the largest length left and the multiset of others that comes closest to
capacity, by a bitset subset-sum over all lengths with binary-split counts and
backtracking; the pattern repeats as often as its counts allow.  Where even the
best multiset leaves slack, a remainder is cut to fill it and its tail returns
to the multiset, so that only the last window is short.

The plan is a small table of (length, rank interval, cut) -> window numbers.
Ranks of equal lengths come from counts per task and length, so a length that
many documents share is never gathered in one place.

Offsets by task and length join the tokens by Spark's own choice: broadcast while
they are below its threshold, else both sides are shuffled.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed each by itself; equal lengths are taken in the order of tasks and rows; a
null doc_id stays null; a long text is tokenised whole and cut into windows; an
empty table gives an empty result; columns other than doc_id and text, whatever
their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import textkit as tk
from sparkloom.llm.shared import saved

END_ID = 1
_TABLE = "doc_id long, task long, ids binary, n long, full_before long, rest long, rest_rank long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str, window: int, end_id: int = END_ID) -> DataFrame:
    """Ids of each document (16 bits where they fit, else 32), with ranks among the documents of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkloom.llm.bpe import ByteBpe

        bpe, task = ByteBpe(tokenizer), TaskContext.get().partitionId()
        full, ranks = 0, np.zeros(window, np.int64)
        for batch in batches:
            for part in tk.text_slices(batch):
                ids, heads = bpe.encode(part.column("text"))
                n = np.diff(heads) + 1
                whole, rest = n // window, n % window
                order = np.argsort(rest, kind="stable")
                runs = np.flatnonzero(np.diff(rest[order], prepend=-1))
                within = np.arange(n.size) - np.repeat(runs, np.diff(runs, append=n.size))
                rank = np.empty(n.size, np.int64)
                rank[order] = within + ranks[rest[order]]
                np.add.at(ranks, rest, 1)
                wide = max(int(ids.max(initial=0)), end_id) > 0xFFFF
                kind = np.uint32 if wide else np.uint16
                small = ids.astype(kind)
                blobs = [b"%c" % (4 if wide else 2) + small[heads[k] : heads[k + 1]].tobytes() + kind(end_id).tobytes() for k in range(n.size)]
                before = full + np.cumsum(whole) - whole
                full += int(whole.sum())
                columns = [part.column("doc_id"), np.full(n.size, task), pa.array(blobs, pa.binary()), n, before, rest, rank]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "task", "ids", "n", "full_before", "rest", "rest_rank"])

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tk.tidy(run), _TABLE), "pack-ids")


def _fill(counts: dict[int, int], room: int) -> list[int]:
    """Lengths of the multiset whose sum comes closest to ``room`` from below."""
    mask, reach = (1 << room + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []  # reach before, length, copies
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, []
    for before, length, copies in reversed(steps):
        if not before >> best & 1:
            best -= length * copies
            out += [length] * copies
    return out


def pack_plan(histogram: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, int, int]], int]:
    """Rows (rest, low rank, high rank, from, to, first sequence, offset) and the number of sequences.

    Ranks low..high-1 of the documents whose remainder has length ``rest`` put
    its tokens from..to into sequence first + rank - low at ``offset``.
    """
    stock: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: (rest, low, high, from)
    counts: dict[int, int] = {}
    for length, n in sorted(histogram.items()):
        if n and length:
            stock[length], counts[length] = [(length, 0, n, 0)], n
    rows, sequences = [], 0

    def take(length: int, times: int, first: int, offset: int, cut: int) -> None:
        """Move ``times`` items, each cut to ``cut`` tokens, to sequences first.. at offset."""
        while times:
            rest, low, high, start = stock[length].pop()
            n = min(times, high - low)
            rows.append((rest, low, low + n, start, start + cut, first, offset))
            if n < high - low:
                stock[length].append((rest, low + n, high, start))
            if cut < length:
                tail = length - cut
                stock.setdefault(tail, []).append((rest, low, low + n, start + cut))
                counts[tail] = counts.get(tail, 0) + n
            counts[length] -= n
            first, times = first + n, times - n

    while largest := max((x for x, n in counts.items() if n), default=0):
        counts[largest] -= 1
        pattern = [largest, *_fill(counts, window - largest)]
        counts[largest] += 1
        need = {x: pattern.count(x) for x in set(pattern)}
        times, slack = min(counts[x] // k for x, k in need.items()), window - sum(pattern)
        filler = 0
        if slack:
            filler = next((x for x in sorted(counts, reverse=True) if x > slack and counts[x] > need.get(x, 0)), 0)
            if filler:
                times = max(1, min([times, counts[filler] // (need.get(filler, 0) + 1)]))
            elif any(n > need.get(x, 0) for x, n in counts.items()):
                times = max(1, times)
        offset = 0
        for x in pattern:
            take(x, times, sequences, offset, x)
            offset += x
        if filler:
            take(filler, times, sequences, offset, slack)
        sequences += times
    return rows, sequences


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; ``with_ids`` adds the ids themselves."""
    table = tokenized(docs, tokenizer, window, end_id)
    by_task = table.groupBy("task", "rest").agg(F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    by_task = saved(by_task, "pack-counts")
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_task.withColumn("rank_before", F.coalesce(F.sum("docs").over(before), F.lit(0))).select("task", "rest", "rank_before")
    full = by_task.groupBy("task").agg(F.sum("full").alias("full"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("full_start", F.coalesce(F.sum("full").over(before), F.lit(0))).select("task", "full_start")
    bases = saved(ranks.join(full, "task"), "pack-bases")
    histogram = {r["rest"]: r["n"] for r in by_task.groupBy("rest").agg(F.sum("docs").alias("n")).collect()}
    n_full = by_task.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    plan = np.array(sorted(pack_plan(histogram, window)[0]), np.int64).reshape(-1, 7)
    cuts = np.searchsorted(plan[:, 0], np.arange(window + 1))
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tk.text_slices(whole, "ids"):
                yield _pieces(batch)

    def _pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        get = {c: batch.column(c).to_numpy() for c in ("n", "full_before", "rest", "rest_rank", "rank_before", "full_start")}
        data, offs = tk.flat(batch.column("ids"))
        docs_at, starts, lengths, crcs, seqs, places, ids_out = [], [], [], [], [], [], []
        rank, first_full = get["rest_rank"] + get["rank_before"], get["full_before"] + get["full_start"]
        for k in range(batch.num_rows):
            wide = data[offs[k]] == 4
            ids = np.frombuffer(data[offs[k] + 1 : offs[k + 1]].tobytes(), np.uint32 if wide else np.uint16).astype("<u4")
            n, rest = int(get["n"][k]), int(get["rest"][k])
            for i in range(n // window):
                docs_at.append(k), starts.append(i * window), lengths.append(window), seqs.append(int(first_full[k]) + i), places.append(0)
            if rest:
                of = plan[cuts[rest] : cuts[rest + 1]]
                at = n - rest
                for _, _low, _, a, b, first, offset in of[(of[:, 1] <= rank[k]) & (rank[k] < of[:, 2])].tolist():
                    docs_at.append(k), starts.append(at + a), lengths.append(b - a), seqs.append(n_full + first + int(rank[k]) - _low), places.append(offset)
            for j in range(len(crcs), len(docs_at)):
                piece = ids[starts[j] : starts[j] + lengths[j]]
                crcs.append(zlib.crc32(piece.tobytes()))
                if with_ids:
                    ids_out.append(piece.astype(np.int32))
        doc = np.array(docs_at, np.int64)
        arrays = [batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs)), pa.array(get["n"][doc]), pa.array(seqs, pa.int64()), pa.array(places, pa.int64())]
        names = [c.split()[0] for c in PIECES.split(", ")]
        if with_ids:
            arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    joined = table.join(bases, ["task", "rest"])
    return joined.select("doc_id", "ids", "n", "full_before", "rest", "rest_rank", "rank_before", "full_start").mapInArrow(tk.tidy(run), schema)
