"""Repeated byte strings of a minimum length, found over all documents.

Every window of ``length`` bytes has an anchor: its least k-gram, leftmost of
equals, by a hash of the bytes alone.  Equal windows have equal anchors at
equal offsets, so only windows whose anchor's k-gram occurs twice can repeat.
The windows of one anchor occurrence are neighbours; together they span a
context.

1. Batches send their distinct (anchor, context) hashes to shards by anchor,
   a row for each shard that they have any for: never more rows than they have
   distinct contexts.  A context that occurs twice (128 bits of hashes over its
   bytes agree) has all its windows repeated and is settled.
2. Where an anchor occurs with several contexts, one copy of each goes to a
   shard by anchor.  There a Burrows-Wheeler transform of the contexts is
   expanded breadth-first: intervals of strings are extended backwards symbol by
   symbol, each new interval end has the common prefix of that step, and after
   ``length`` steps the ends without a value are neighbours that share at least
   ``length`` bytes.  Those windows repeat.  An anchor with over ``hot`` contexts
   is settled by counts of its single windows' hashes instead, so no shard grows
   with one common passage.
3. Batches merge the spans and drop the bytes.

On the documents of sf0.1 step 1 settles 91 % of the repeated windows, whole
copies and passages for the most part, and step 2 finds the other 9 %, at the
edges of passages.

Defined cases: null and empty texts lose nothing; texts below ``length`` bytes
neither; repeated rows repeat each other entirely; a window inside one document
counts as repeated when it starts elsewhere in it, overlaps included; of equal
k-grams in a window the leftmost is its anchor; matches never cross documents; a
null doc_id stays null; a long text is hashed whole, within some tens of bytes
for each byte of it; empty tables give empty results; further columns, whatever
their names, are not read by ``removal_report`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.llm import textkit as tk
from sparkloom.llm.batches import SMALL_PAGES, answered, batch_table, by_shard, doc_slices, from_bytes
from sparkloom.llm.shared import input_bytes, saved

GRAM = 64
_SEPARATOR = 0xFF  # in no UTF-8 text
_ENTRY = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("twice", "u1")])
SETTLED, SEND, WANTED = 1, 2, 4
_SLICE = 1 << 18  # bytes of text hashed at a time: some tens of bytes are held for each


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least of each ``width`` neighbours by the upper 33 bits, the leftmost of equal ones: the same place in equal windows of any two slices."""
    bits = np.uint64(31)
    key = h >> bits << bits | np.arange(h.size, dtype=np.uint64)
    n = h.size - width + 1
    blocks = -(-h.size // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: h.size] = key
    grid = padded.reshape(blocks, width)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], front[width - 1 : width - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class Contexts:
    """Anchors of a slice: hash, first and last window (as byte offsets of the slice), context hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int):
        n = int(offs[-1])
        gram = min(GRAM, length)
        if n < length:
            self.first = self.last = np.zeros(0, np.int64)
            self.anchor = self.context = np.zeros(0, tk.U)
            return
        rolling = tk.Rolling(data, n)
        h = rolling.windows(gram)
        at = _sliding_argmin(h, length - gram + 1)  # anchor of each window
        starts = np.ones(at.size, bool)
        starts[1:] = at[1:] != at[:-1]
        room = np.zeros(n + 1, np.int64)  # windows must end inside their document
        sizes = np.diff(offs)
        full = sizes >= length
        np.add.at(room, offs[:-1][full], 1)
        np.add.at(room, offs[1:][full] - length + 1, -1)
        valid = np.cumsum(room)[: at.size] > 0
        starts |= np.diff(valid, prepend=False) != 0
        starts[offs[:-1][full]] = True
        first = np.flatnonzero(starts)
        last = np.append(first[1:], at.size) - 1
        good = valid[first]
        self.first, self.last = first[good], last[good]
        where = at[self.first]
        self.anchor = tk.mix(h[where] + tk._M2)  # least hashes crowd at the low end; shards go by range
        self.context = tk.mix(rolling.ranges(self.first, self.last + length) ^ tk.mix((where - self.first).astype(tk.U) + tk._M1))


def _entries(docs: pa.RecordBatch, length: int) -> np.ndarray:
    parts = []
    for _, part in doc_slices(docs, limit=_SLICE):
        c = Contexts(*tk.flat(part.column("text")), length)
        one = np.zeros(c.anchor.size, _ENTRY)
        one["anchor"], one["context"] = c.anchor, c.context
        parts.append(one)
    both = np.concatenate(parts) if parts else np.zeros(0, _ENTRY)
    both = both[np.lexsort((both["context"], both["anchor"]))]
    same = (both["anchor"][1:] == both["anchor"][:-1]) & (both["context"][1:] == both["context"][:-1])
    new = np.flatnonzero(np.append(True, ~same)) if both.size else np.zeros(0, np.int64)
    out = both[new]
    out["twice"] = np.diff(new, append=both.size) > 1
    return out


def _anchors(length: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, rows in zip(batch.column("bid").to_pylist(), batch.column("rows"), strict=True):
                entries = _entries(from_bytes(rows.as_py()), length)
                shard, cuts = by_shard(entries["anchor"], shards)
                for s, a, b in zip(shard.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    yield pa.RecordBatch.from_pydict({"shard": [s], "bid": [bid], "entries": [entries[a:b].tobytes()]})

    return run


def _judge(table: pa.Table) -> pa.Table:
    """For one shard: what each batch must do with those of its contexts whose anchor occurs elsewhere."""
    blobs = [x.as_py() for x in table.column("entries")]
    each = np.array([len(x) // _ENTRY.itemsize for x in blobs])
    e = np.frombuffer(b"".join(blobs), _ENTRY)
    bid = np.repeat(table.column("bid").to_numpy(), each)
    order = np.lexsort((bid, e["context"], e["anchor"]))
    e, bid = e[order], bid[order]
    new_anchor = np.append(True, e["anchor"][1:] != e["anchor"][:-1])
    new_pair = new_anchor | np.append(True, e["context"][1:] != e["context"][:-1])
    group, pair = np.cumsum(new_anchor) - 1, np.cumsum(new_pair) - 1
    times = np.bincount(pair, 1 + e["twice"]).astype(np.int64)[pair]  # 2 stands for any more
    contexts = np.bincount(group[new_pair])[group]
    mixed = contexts > 1
    single = times == 1
    open_group = np.bincount(group, single).astype(np.int64)[group] > 0
    action = np.where(~single, SETTLED, 0) | np.where(mixed & open_group & new_pair, SEND, 0) | np.where(mixed & single, SEND | WANTED, 0)
    keep = np.flatnonzero(action)
    keep = keep[np.argsort(bid[keep], kind="stable")]
    out = np.zeros(keep.size, np.dtype([("anchor", "<u8"), ("context", "<u8"), ("action", "u1")]))
    out["anchor"], out["context"], out["action"] = e["anchor"][keep], e["context"][keep], action[keep]
    cuts = np.flatnonzero(np.diff(bid[keep], prepend=-1))
    ends = np.append(cuts[1:], keep.size)[: cuts.size]
    return pa.table({"bid": pa.array(bid[keep][cuts], pa.int64()), "answer": pa.array([out[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})


_ANSWER = np.dtype([("anchor", "<u8"), ("context", "<u8"), ("action", "u1")])
_FOUND = "bid long, row long, first long, last long, anchor long, wanted boolean, bytes binary"


def _act(length: int):
    """Settled spans (without bytes) and the contexts to send, from a batch and its answers."""

    def run(bid: int, docs: pa.RecordBatch, answers: pa.Table) -> list[pa.Table]:
        known = np.frombuffer(b"".join(x.as_py() for x in answers.column("answer")), _ANSWER)
        if not known.size:
            return []
        mark = tk.mix(known["anchor"] ^ tk.mix(known["context"]))
        order = np.argsort(mark)
        mark, action = mark[order], known["action"][order]
        sent: set[int] = set()
        out = []
        for row, part in doc_slices(docs, limit=_SLICE):
            data, offs = tk.flat(part.column("text"))
            c = Contexts(data, offs, length)
            own = tk.mix(c.anchor ^ tk.mix(c.context))
            at = np.minimum(np.searchsorted(mark, own), mark.size - 1)
            todo = np.where(mark[at] == own, action[at], 0)
            doc = np.searchsorted(offs, c.first, "right") - 1
            base = offs[doc]
            rows, firsts, lasts, anchors, wanted, blobs = [], [], [], [], [], []
            settled = np.flatnonzero(todo & SETTLED)
            for k in np.flatnonzero(todo & SEND).tolist():
                if int(own[k]) in sent:
                    continue
                sent.add(int(own[k]))
                rows.append(row + doc[k])
                firsts.append(c.first[k] - base[k])
                lasts.append(c.last[k] - base[k])
                anchors.append(c.anchor[k])
                wanted.append(bool(todo[k] & WANTED))
                blobs.append(data[c.first[k] : c.last[k] + length].tobytes())
            # runs of settled contexts merge before they leave the task
            f, t, d = (c.first - base)[settled], (c.last - base)[settled], doc[settled]
            new = np.append(True, (d[1:] != d[:-1]) | (f[1:] > t[:-1] + 1)) if settled.size else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            ends = np.append(heads[1:], settled.size) - 1 if settled.size else heads
            n = heads.size
            out.append(
                pa.table(
                    {
                        "bid": pa.array(np.full(n + len(rows), bid), pa.int64()),
                        "row": pa.array(np.concatenate([row + d[heads], np.array(rows, np.int64)]), pa.int64()),
                        "first": pa.array(np.concatenate([f[heads], np.array(firsts, np.int64)]), pa.int64()),
                        "last": pa.array(np.concatenate([t[ends], np.array(lasts, np.int64)]), pa.int64()),
                        "anchor": pa.array(np.concatenate([np.zeros(n, np.int64), np.array(anchors, np.uint64).view(np.int64)]), pa.int64()),
                        "wanted": pa.array([None] * n + wanted, pa.bool_()),
                        "bytes": pa.array([None] * n + blobs, pa.binary()),
                    }
                )
            )
        return out

    return run


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` bytes at least, by prefix doubling."""
    n = text.size
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    known = 8
    while True:
        ordered = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])).astype(np.uint64)
        if known >= depth or int(rank[order[-1]]) == n - 1:
            return order
        later = np.zeros(n, np.uint64)
        if known < n:
            later[: n - known] = rank[known:] + np.uint64(1)
        key = rank << np.uint64(32) | later
        order = np.argsort(key)
        known *= 2


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """Starts of all ``length``-byte strings that start twice or more; none may hold a separator.

    Common prefixes of neighbouring suffixes come out by increasing value: an
    interval of suffixes that share a string of l bytes is extended backwards
    by every symbol before them, and an end that no shorter string has marked
    gets the value l.  After ``length`` rounds the unmarked ends are matches.
    """
    n = text.size
    if n < length + 1:
        return np.zeros(0, np.int64)
    order = suffix_order(text, length)
    before = text[order - 1].astype(np.int64)  # the transform
    keys = before * n + np.arange(n)
    keys.sort()
    marked = np.zeros(n + 1, bool)
    marked[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        if not low.size:
            break
        sizes = high - low
        pairs = np.repeat(np.arange(low.size) * 256, sizes) + before[tk.ragged(low, sizes)]
        if low.size * 256 < 4 * pairs.size:
            seen = np.zeros(low.size * 256, bool)
            seen[pairs] = True
            pairs = np.flatnonzero(seen)
        else:
            pairs = np.unique(pairs)
        owner, symbol = pairs >> 8, pairs & 255
        real = symbol != _SEPARATOR
        owner, symbol = owner[real], symbol[real]
        low, high = np.searchsorted(keys, symbol * n + low[owner]), np.searchsorted(keys, symbol * n + high[owner])
        fresh = np.flatnonzero(~marked[high])
        _, first = np.unique(high[fresh], return_index=True)
        fresh = fresh[first]
        low, high = low[fresh], high[fresh]
        marked[high] = True
    same = np.flatnonzero(~marked)
    starts = np.zeros(n, bool)
    starts[order[same]] = starts[order[same - 1]] = True
    stops = np.flatnonzero(text == _SEPARATOR)
    room = np.append(stops, n)[np.searchsorted(stops, np.arange(n))] - np.arange(n)
    return np.flatnonzero(starts & (room >= length))


_SPANS = "bid long, row long, first long, last long"


def _expand(length: int):
    """Contexts of one shard to spans of repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        blobs = [x.as_py() for x in table.column("bytes")]
        sizes = np.array([len(x) + 1 for x in blobs])
        base = np.cumsum(sizes) - sizes
        text = np.frombuffer(b"\xff".join(blobs) + b"\xff", np.uint8)
        at = repeated_starts(text, length)
        tk.release()
        owner = np.searchsorted(base, at, "right") - 1
        at = at - base[owner]
        good = table.column("wanted").to_numpy()[owner].astype(bool)
        at, owner = at[good], owner[good]
        new = np.append(True, (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + 1)) if at.size else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], at.size) - 1 if at.size else heads
        who = owner[heads]
        first = table.column("first").to_numpy()[who]
        return pa.table({"bid": pa.array(table.column("bid").to_numpy()[who]), "row": pa.array(table.column("row").to_numpy()[who]), "first": pa.array(first + at[heads]), "last": pa.array(first + at[ends])})

    return run


def _single_windows(length: int):
    """Contexts of hot anchors as rows of single windows: two hashes and the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.text_slices(batch, "bytes", 1 << 18):
                data, offs = tk.flat(part.column("bytes"))
                w = tk.Rolling(data, int(offs[-1])).windows(length)
                second = tk.Rolling(data[::-1].copy()[16:], int(offs[-1])).windows(length)[::-1]
                counts = np.maximum(np.diff(offs) - length + 1, 0)
                at = tk.ragged(offs[:-1], counts)
                who = np.repeat(np.arange(part.num_rows), counts)
                first = part.column("first").to_numpy()[who] + at - offs[:-1][who]
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[at].view(np.int64)), pa.array(second[at].view(np.int64)), part.column("bid").take(take), part.column("row").take(take), pa.array(first), part.column("wanted").take(take)],
                    ["w1", "w2", "bid", "row", "first", "wanted"],
                )

    return run


def repeated_spans(batches: DataFrame, length: int = 200, hot: int = 16384, shard_bytes: int = 8 << 20) -> DataFrame:
    """(bid, row, first, last): windows starting at first..last of that row of a batch occur elsewhere too."""
    shards = max(8, input_bytes(batches) // shard_bytes)
    entries = batches.mapInArrow(tk.tidy(_anchors(length, shards)), "shard long, bid long, entries binary")
    answers = entries.groupBy("shard").applyInArrow(_judge, "bid long, answer binary")
    found = saved(answered(batches, answers, _act(length), _FOUND), "substring-contexts")
    spans = found.where("bytes is null").select("bid", "row", "first", "last")
    sent = found.where("bytes is not null")
    stats = sent.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.length("bytes")).alias("size"))
    stats = saved(stats, "substring-anchors")
    total = stats.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    common = stats.where(F.col("n") > hot).select("anchor")
    if not common.isEmpty():
        single = saved(sent.join(common, "anchor", "left_semi").mapInArrow(tk.tidy(_single_windows(length)), "w1 long, w2 long, bid long, row long, first long, wanted boolean"), "substring-windows")
        twice = single.groupBy("w1", "w2").count().where("count > 1").drop("count")
        spans = spans.union(single.where("wanted").join(twice, ["w1", "w2"], "left_semi").select("bid", "row", "first", F.col("first").alias("last")))
        sent = sent.join(common, "anchor", "left_anti")
    parts = max(16, total // (shard_bytes // 8))
    grouped = sent.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(parts))).groupBy("shard").applyInArrow(_expand(length), _SPANS)
    return spans.union(grouped)


def _cover(docs: pa.RecordBatch, spans: pa.Table, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of the removed runs of each row."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * docs.num_rows
    if not spans.num_rows:
        return out
    row, first, end = spans.column("row").to_numpy(), spans.column("first").to_numpy(), spans.column("last").to_numpy() + length
    order = np.lexsort((first, row))
    row, first, end = row[order], first[order], end[order]
    cuts = np.append(np.flatnonzero(np.diff(row, prepend=-1)), row.size)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        reach = np.maximum.accumulate(end[a:b])
        heads = np.flatnonzero(np.append(True, first[a + 1 : b] > reach[:-1]))
        out[row[a]] = (first[a:b][heads], reach[np.append(heads[1:], b - a) - 1])
    return out


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    at, parts = 0, []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]])


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_report(docs: DataFrame, length: int = 200) -> DataFrame:
    """What is removed of each document, and the digest of the rest."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    batches = batch_table(slim, "substring-batches", compression="none", **SMALL_PAGES)  # its rows are compressed
    spans = repeated_spans(batches, length)

    def run(bid: int, rows: pa.RecordBatch, found: pa.Table) -> list[pa.Table]:
        out = []
        texts, ids = rows.column("text"), rows.column("doc_id").to_pylist()
        for k, (starts, ends) in enumerate(_cover(rows, found, length)):
            text = texts[k].as_buffer()
            text = text.to_pybytes() if text is not None else b""
            out.append((ids[k], len(text), int((ends - starts).sum()), starts.size, hashlib.sha256(_kept(text, starts, ends)).hexdigest()))
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in REPORT.split(", "))])
        return [pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)] if out else []

    return answered(batches, spans, run, REPORT)


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The documents with repeated bytes removed; a character cut in two goes as a whole, and n_chars follows the text."""
    batches = batch_table(docs, "substring-batches", compression="none", **SMALL_PAGES)  # its rows are compressed
    spans = repeated_spans(batches, length)
    schema: StructType = docs.schema
    names = docs.columns

    def run(bid: int, rows: pa.RecordBatch, found: pa.Table) -> list[pa.Table]:
        texts = rows.column("text").to_pylist()
        for k, (starts, ends) in enumerate(_cover(rows, found, length)):
            if starts.size:
                texts[k] = _kept(texts[k].encode(), starts, ends).decode("utf-8", "ignore")
        columns = {n: rows.column(n) for n in names}
        columns["text"] = pa.array(texts, rows.schema.field("text").type)
        if "n_chars" in columns and pa.types.is_integer(rows.schema.field("n_chars").type):
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], rows.schema.field("n_chars").type)
        return [pa.table(columns)]

    return answered(batches, spans, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema))
