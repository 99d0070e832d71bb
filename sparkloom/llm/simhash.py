"""SimHash near-duplicates by the general pigeonhole principle.

A fingerprint has a bit set where over half of the XXH64 values (seed 42) of a
text's word shingles have it set.  Fingerprints link at ``radius`` or fewer
differing bits, and documents of linked fingerprints form components.

Search: equal fingerprints collapse first.  Bits that vary together go to the
same partition; thresholds t_i >= -1 with sum(t_i) = radius - m + 1 are chosen
by dynamic programming on estimated candidates and probes, and a pair within
the radius is within t_i in some partition i.  Every fingerprint indexes its
key in each partition and probes all keys within t_i; pairs that meet are
verified over all 64 bits.  A bucket with over ``bucket_rows`` entries is split
by keys on five further groups of bits (one of which agrees for any true pair)
instead of being compared as a whole, and tasks return spanning stars, never
all pairs of a bucket.

What is still larger after four such splits is compared in blocks (``in_blocks``).

Defined cases: null and empty texts have fingerprint zero and link with each
other; texts below the shingle size are one shingle; a bit that exactly half of
the hashes have stays 0; repeated rows share a component; a null doc_id never
names a component unless all its members are null; a long text is hashed whole,
within some tens of bytes for each byte of it; an empty table gives an empty
result; further columns, whatever their names, are not read, and kept by
``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkit as tk
from sparkloom.llm.components import components, stars
from sparkloom.llm.shared import free_name, saved

BITS = 64
_SPREAD = np.array([int.from_bytes(bytes((v >> k) & 1 for k in range(8)), "little") for v in range(256)], dtype=np.uint64)


def shingle_hashes(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, and the index of each text's first (one more at the end)."""
    raw, offs = tk.flat(column)
    n = int(offs[-1])
    starts, ends, firsts = tk.words(raw, offs, tk.SPACE_WORDS)
    inside = tk.SPACE_WORDS[raw[:n]]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # one byte after each word becomes the space that joins it to the next
    joined = np.where(inside, tk.LOWER[raw[:n]], np.uint8(0x20))[keep].tobytes()
    moved = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=moved[1:])
    counts = np.diff(firsts)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = tk.ragged(firsts[:-1], shingles)
    last = np.minimum(first + size - 1, np.repeat(firsts[1:] - 1, shingles))
    digest = xxhash.xxh64_intdigest
    begin, stop = moved[starts[first]].tolist(), (moved[ends[last] - 1] + 1).tolist()
    hashes = np.array([digest(joined[b:e], 42) for b, e in zip(begin, stop, strict=True)], dtype=np.uint64)
    heads = np.zeros(counts.size + 1, np.int64)
    np.cumsum(shingles, out=heads[1:])
    return hashes, heads


def majority(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Per text, the bits set in over half of its hashes."""
    counts = np.diff(heads)
    steps = -(-counts // 255)  # lanes of 8 bits hold sums of 255 ones
    cut = tk.ragged(np.zeros(counts.size, np.int64), steps) * 255 + np.repeat(heads[:-1], steps)
    votes = np.zeros((counts.size, BITS), np.int64)
    if cut.size:
        rows = np.repeat(np.arange(counts.size), steps)
        groups = np.flatnonzero(np.diff(rows, prepend=-1))
        for byte in range(8):
            lanes = np.add.reduceat(_SPREAD[(hashes >> np.uint64(8 * byte)).astype(np.uint8)], cut)
            ones = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
            votes[rows[groups], 8 * byte : 8 * byte + 8] = np.add.reduceat(ones, groups, axis=0)
    return np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and its fingerprint fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.text_slices(batch):
                fp = majority(*shingle_hashes(part.column("text"), shingle)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tk.tidy(run), "doc_id long, fp long")


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for k in range(0, fp.size, 65536):
            bits = np.unpackbits(fp[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += np.rint(bits.T @ bits).astype(np.int64)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i * BITS + j), pa.array(total[i, j])], ["ij", "n"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often two bits are set together, over all of them."""
    both = np.zeros((BITS, BITS))
    for ij, n in distinct.select("fp").mapInArrow(tk.tidy(_bit_counts), "ij long, n long").groupBy("ij").sum("n").collect():
        both[ij // BITS, ij % BITS] = both[ij % BITS, ij // BITS] = n
    return distinct.count(), both


def correlated_groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits, grown one after the other by the strongest correlation with the group so far."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [min(left, key=lambda b: (-spread[b], b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def _within(differs: np.ndarray, most: int) -> list[float]:
    """P(at most t of these bits differ) for t = 0..most."""
    dist = np.zeros(differs.size + 1)
    dist[0] = 1
    for q in differs:
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)[: most + 1].tolist()


PROBE_COST, PAIR_COST = 3e-6, 5e-9


def allocate(n: int, both: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least estimated cost with sum radius - m + 1, each -1 (unused) or more."""
    p = np.diag(both) / max(n, 1)
    m = len(groups)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by sum of t_i + 1
    for group in groups:
        near = _within(2 * p[group] * (1 - p[group]), radius)
        new: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, radius + 1):
                probes = 1 + sum(comb(len(group), d) for d in range(1, t + 1))
                add = 0.0 if t < 0 else n * probes * PROBE_COST + n * n / 2 * near[t] * PAIR_COST
                key = total + t + 1
                if key <= radius + 1 and (key not in new or cost + add < new[key][0]):
                    new[key] = (cost + add, [*chosen, t])
        best = new
    return best.get(radius + 1, (float("inf"), [0] * m))


def plan_search(n: int, both: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the used partitions, over the best number of partitions."""
    plans = []
    for m in range(2, radius + 2):
        groups = correlated_groups(n, both, m)
        cost, chosen = allocate(n, both, groups, radius)
        plans.append((cost, m, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[:2])[2] if plans else [(list(range(BITS)), radius)]


def _balls(bits: list[int], t: int) -> np.ndarray:
    """All masks of up to t of these bits."""
    masks, level = [0], [(0, -1)]
    for _ in range(t):
        level = [(mask | 1 << bits[k], k) for mask, last in level for k in range(last + 1, len(bits))]
        masks += [mask for mask, _ in level]
    return np.array(masks, dtype=np.uint64)


def _keys(plan: list[tuple[list[int], int]]):
    """Rows (bucket, fp, probe): the own key of each partition, and all keys within its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, all_fp.size, 8192):
                fp = all_fp[k : k + 8192]
                for i, (bits, t) in enumerate(plan):
                    own = fp & np.uint64(sum(1 << b for b in bits))
                    for mask in _balls(bits, t).tolist():
                        bucket = tk.mix((own ^ np.uint64(mask)) + np.uint64(int(tk._M3) * (i + 1) % (1 << 64))).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(fp.view(np.int64)), pa.array(np.full(fp.size, mask != 0))], ["bucket", "fp", "probe"])

    return run


def _finer(level: int):
    """The same rows under keys of five groups of bits, another grouping at each level."""
    order = np.random.default_rng(level).permutation(BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fp = batch.column("bucket").to_numpy().view(np.uint64), batch.column("fp").to_numpy().view(np.uint64)
            for j in range(5):
                part = fp & np.uint64(sum(1 << int(b) for b in order[j::5]))
                new = tk.mix(tk.mix(bucket + np.uint64(j + 1)) ^ tk.mix(part + tk._M3)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(new), batch.column("fp"), batch.column("probe")], ["bucket", "fp", "probe"])

    return run


def _links(radius: int):
    """Verified links inside buckets of a partition sorted by bucket, as stars."""

    def verify(bucket: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        at, d = np.arange(bucket.size), 1
        while at.size:
            at = at[at + d < bucket.size]
            at = at[bucket[at] == bucket[at + d]]
            near = at[~(probe[at] & probe[at + d])]
            near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= radius]
            near = near[fp[near] != fp[near + d]]
            a.append(fp[near].view(np.int64))
            b.append(fp[near + d].view(np.int64))
            held, d = held + near.size, d + 1
            if held > 1_000_000:
                x, y = stars(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], x.size
        if held:
            x, y = stars(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]
        for batch in batches:
            new = (batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("probe").to_numpy(zero_copy_only=False))
            rest = [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if rest[0].size < 200_000:
                continue
            cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on
            if cut:
                yield from verify(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]
        yield from verify(*rest)

    return run


def in_blocks(rows: DataFrame, buckets: DataFrame, key: str, bucket_rows: int) -> DataFrame:
    """Rows of buckets with over ``bucket_rows`` entries under a bucket for each pair of blocks of them.

    All pairs still meet, but no task holds more than two blocks; a bucket of n
    rows becomes n / bucket_rows copies of each, for which reason this is the last
    resort.  ``buckets`` has the column bucket of all rows.
    """
    hot = saved(buckets.groupBy("bucket").count().where(F.col("count") > bucket_rows).withColumnRenamed("bucket", "hot"), "simhash-blocks")
    if hot.isEmpty():
        return rows
    blocks = F.ceil(F.col("count") / bucket_rows)
    own, other = F.pmod(F.xxhash64(key), blocks), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(blocks, F.lit(1)) - 1)).alias("other")
    met = rows.join(hot, rows["bucket"] == hot["hot"], "left").select(*rows.columns, "count", own.alias("own"), other)
    bucket = F.when(F.col("count").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    return met.select(bucket.alias("bucket"), *(c for c in rows.columns if c != "bucket"))


def links(distinct: DataFrame, radius: int = 4, bucket_rows: int = 4096, levels: int = 4, block_rows: int = 65536) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within the radius."""
    plan = plan_search(*bit_statistics(distinct), radius)
    rows = distinct.select("fp").mapInArrow(tk.tidy(_keys(plan)), "bucket long, fp long, probe boolean")
    found = None
    for level in range(levels):
        last = level == levels - 1 or radius > 4  # five groups always hold one that agrees up to radius 4
        if not last:
            rows = saved(rows, "simhash-keys")
            hot = saved(rows.groupBy("bucket").count().where(F.col("count") > bucket_rows).select("bucket"), "simhash-hot")
            last = hot.isEmpty()
        else:
            rows = saved(rows, "simhash-keys")
            rows = in_blocks(rows, rows.select("bucket"), "fp", block_rows)
        small = rows if last else rows.join(hot, "bucket", "left_anti")
        new = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tk.tidy(_links(radius)), "a long, b long")
        found = new if found is None else found.union(new)
        if last:
            break
        rows = rows.join(hot, "bucket", "left_semi").mapInArrow(tk.tidy(_finer(level + 1)), "bucket long, fp long, probe boolean").distinct()
    return saved(found.distinct(), "simhash-links")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that links reach."""
    fps = saved(fingerprints(docs, shingle), "simhash-fp")
    distinct = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = components(links(distinct, radius, bucket_rows))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = saved(classes.join(lowest, "root").select(F.col("fp").alias("f"), "component_id"), "simhash-classes")
    out = fps.join(classes, fps["fp"] == classes["f"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similar documents: longer fingerprints, and thresholds for a wanted recall.

_WIDE = "id long, fp binary"


SHORT = 20


def distinct_shingles(hashes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes once, ascending, and the index of its first."""
    rows = np.repeat(np.arange(heads.size - 1), np.diff(heads))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(hashes.size, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], np.append(0, np.cumsum(np.bincount(rows[new], minlength=heads.size - 1)))


def text_key(text: F.Column) -> F.Column:
    """MD5 of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def wide_fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, the text's MD5, a fingerprint of ``words`` times 64 bits, each from another mix of the distinct shingles' hashes, and these themselves where they are ``SHORT`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.text_slices(batch):
                hashes, heads = distinct_shingles(*shingle_hashes(part.column("text"), shingle))
                few = [hashes[a:b].tobytes() if b - a <= SHORT else None for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True)]
                fp = np.stack([majority(hashes if k == 0 else tk.mix(hashes + np.uint64(k)), heads) for k in range(words)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(few, pa.binary())], ["doc_id", "key", "fp", "few"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs["text"]).alias("key"), "text").mapInArrow(tk.tidy(run), "doc_id long, key binary, fp binary, few binary")


def _rows_of(column: pa.Array, words: int) -> np.ndarray:
    return tk.flat(column)[0][: len(column) * 8 * words].view(np.uint64).reshape(-1, words)


def _wide_bit_counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words, BITS, BITS), np.int64)
        for batch in batches:
            fp = _rows_of(batch.column("fp"), words)
            for k in range(0, len(fp), 16384):
                for w in range(words):
                    bits = np.unpackbits(np.ascontiguousarray(fp[k : k + 16384, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                    total[w] += np.rint(bits.T @ bits).astype(np.int64)
        i, j = np.triu_indices(BITS)
        for w in range(words):
            yield pa.RecordBatch.from_arrays([pa.array((w * BITS + i) * BITS + j), pa.array(total[w, i, j])], ["ij", "n"])

    return run


def plan_recall(n: int, both: np.ndarray, differs: float, recall: float, most: int = 1) -> list[tuple[int, list[int], int]]:
    """(word, bits, threshold) of least estimated cost that finds ``recall`` of the pairs whose bits differ at that rate.

    A pair is missed when it exceeds the threshold in every partition; the
    logarithms of these chances add up, and the allocation is a knapsack over
    them, for two to five partitions a word.
    """
    scale, plans = 200 / -np.log(1 - recall), []
    for m in range(2, 6):
        best: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for w in range(both.shape[0]):
            p = np.diag(both[w]) / max(n, 1)
            for bits in correlated_groups(n, both[w], m):
                near, width = _within(2 * p[bits] * (1 - p[bits]), most), len(bits)
                found = np.cumsum([comb(width, d) * differs**d * (1 - differs) ** (width - d) for d in range(most + 1)])
                worth = np.floor(-np.log(1 - found) * scale).astype(int)
                new = dict(best)
                for total, (cost, chosen) in best.items():
                    for t in range(most + 1):
                        probes = sum(comb(width, d) for d in range(t + 1))
                        key = min(200, total + int(worth[t]))
                        add = cost + n * probes * PROBE_COST + n * n / 2 * near[t] * PAIR_COST * 4
                        if key not in new or add < new[key][0]:
                            new[key] = (add, [*chosen, (w, bits, t)])
                best = new
        reached = max(best)
        plans.append((-reached, *best[reached]))
    return min(plans, key=lambda x: x[:2])[2]


def _wide_keys(plan: list[tuple[int, list[int], int]], words: int, alone: bool = False):
    """Rows (bucket, id, fp) under all keys of each fingerprint, or their buckets alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                fp = _rows_of(part.column("fp"), words)
                for i, (w, bits, t) in enumerate(plan):
                    own = fp[:, w] & np.uint64(sum(1 << b for b in bits))
                    for mask in _balls(bits, t).tolist():
                        bucket = tk.mix((own ^ np.uint64(mask)) + np.uint64(int(tk._M3) * (i + 1) % (1 << 64))).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket)] if alone else [pa.array(bucket), part.column("id"), part.column("fp")], ["bucket"] if alone else ["bucket", "id", "fp"])

    return run


def _wide_links(words: int, radius: int):
    """Stars with the components of all pairs within the radius in each bucket."""
    first = min(words, max(1, 2 * radius // BITS + 2))  # unrelated pairs exceed the radius within these words

    def of_bucket(ids: np.ndarray, fp: np.ndarray, a: list, b: list) -> None:
        """Every member that was reached is held against all that weren't; pairs of reached members add nothing."""
        left, cols, at, wave = np.arange(ids.size), np.ascontiguousarray(fp.T), 0, np.zeros(0, np.int64)
        alive, gone = np.ones(ids.size, bool), 0
        while gone < left.size:
            if at == wave.size:  # a component is complete, the next one starts
                k = int(np.argmax(alive))
                at, wave, alive[k], gone = 0, left[k : k + 1], False, gone + 1
            head, at = wave[at], at + 1
            far = np.zeros(left.size, np.uint16)
            for w in range(first):
                far += np.bitwise_count(cols[w] ^ fp[head, w])
            near = np.flatnonzero((far <= radius) & alive)
            near = near[np.bitwise_count(fp[left[near]] ^ fp[head]).sum(axis=1) <= radius]
            if near.size:
                a.append(np.full(near.size, ids[head]))
                b.append(ids[left[near]])
                wave = np.append(wave[at:], left[near])
                at, alive[near], gone = 0, False, gone + near.size
            if 2 * gone > left.size:
                left, cols = left[alive], np.ascontiguousarray(cols[:, alive])
                alive, gone = np.ones(left.size, bool), 0

    def verify(bucket: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)), bucket.size)
        sizes = np.diff(cuts)
        d, at = 1, np.flatnonzero(np.repeat(sizes <= 64, sizes))
        while at.size:
            at = at[at + d < bucket.size]
            at = at[bucket[at] == bucket[at + d]]
            for k in range(0, at.size, 1 << 16):
                x = at[k : k + (1 << 16)]
                near = x[np.bitwise_count(fp[x] ^ fp[x + d]).sum(axis=1) <= radius]
                a.append(ids[near])
                b.append(ids[near + d])
            d += 1
        for k in np.flatnonzero(sizes > 64).tolist():
            of_bucket(ids[cuts[k] : cuts[k + 1]], fp[cuts[k] : cuts[k + 1]], a, b)
        x, y = stars(np.concatenate(a), np.concatenate(b))
        if x.size:
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, words), np.uint64)]
        for batch in batches:
            new = (batch.column("bucket").to_numpy(), batch.column("id").to_numpy(), _rows_of(batch.column("fp"), words))
            rest = [np.concatenate(x) for x in zip(rest, new, strict=True)]
            if rest[0].size < 100_000:
                continue
            cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on
            if cut:
                yield from verify(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]
        if rest[0].size:
            yield from verify(*rest)

    return run


def _short_keys(similarity: float):
    """Rows (bucket, id, few): sets of that similarity share one of their first size - needed + 1 members in any one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.int64) for x in batch.column("few").to_pylist()]
            takes = [x.size - int(np.ceil(similarity * x.size - 1e-9)) + 1 if x.size else 0 for x in sets]
            at = np.repeat(np.arange(len(sets)), takes)
            bucket = np.concatenate([np.zeros(0, np.int64), *(x[:k] for x, k in zip(sets, takes, strict=True))])
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("id").take(pa.array(at)), batch.column("few").take(pa.array(at))], ["bucket", "id", "few"])

    return run


def _short_links(similarity: float):
    """Stars with the components of all pairs of small sets of that Jaccard similarity in each bucket."""

    def of_bucket(ids: np.ndarray, sets: list[bytes], a: list, b: list) -> None:
        size = np.array([len(x) // 8 for x in sets])
        flat, owner = np.frombuffer(b"".join(sets), np.uint64), np.repeat(np.arange(size.size), size)
        order = np.argsort(flat, kind="stable")
        member, owner = flat[order], owner[order]
        alive, wave = np.ones(size.size, bool), []
        for k in range(size.size):  # what was reached is held against all that wasn't
            if alive[k]:
                wave, alive[k] = [k], False
            while wave:
                head = wave.pop()
                own = np.frombuffer(sets[head], np.uint64)
                lo, hi = np.searchsorted(member, own), np.searchsorted(member, own, "right")
                common = np.bincount(np.concatenate([owner[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]), minlength=size.size)
                near = np.flatnonzero(alive & (common >= similarity * (size + size[head] - common) - 1e-9))
                a.append(np.full(near.size, ids[head]))
                b.append(ids[near])
                alive[near] = False
                wave += near.tolist()

    def verify(bucket: np.ndarray, ids: np.ndarray, sets: list[bytes]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)), bucket.size)
        for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
            of_bucket(ids[cuts[k] : cuts[k + 1]], sets[cuts[k] : cuts[k + 1]], a, b)
        x, y = stars(np.concatenate(a), np.concatenate(b))
        if x.size:
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, sets = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            bucket, ids = np.append(bucket, batch.column("bucket").to_numpy()), np.append(ids, batch.column("id").to_numpy())
            sets += batch.column("few").to_pylist()
            cut = int(np.searchsorted(bucket, bucket[-1])) if bucket.size >= 100_000 else 0  # the last bucket may go on
            if cut:
                yield from verify(bucket[:cut], ids[:cut], sets[:cut])
                bucket, ids, sets = bucket[cut:], ids[cut:], sets[cut:]
        if bucket.size:
            yield from verify(bucket, ids, sets)

    return run


def similar_texts(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 8, recall: float = 0.97, block_rows: int = 65536) -> DataFrame:
    """(doc_id, key, low) of every row: its text's MD5 and the row of its group that stays, a struct (no_id, doc_id, key).

    Documents link where the Jaccard similarity of their shingles is estimated
    at ``similarity`` or more.  A Jaccard similarity J of equal-sized sets is a
    cosine of 2J / (1 + J), and a fingerprint bit differs with the angle's share
    of a half turn.  A radius that guarantees such pairs by the pigeonhole would
    probe nearly all pairs, so the thresholds are allocated for a recall at the
    border; it is higher for closer pairs.  Verification is over all bits, two
    standard deviations past the expected distance.  Pairs of texts with at most
    ``SHORT`` distinct shingles are compared by these, exactly and all of them;
    shorter texts than such a similarity to a longer one allows stay out of the
    fingerprint search.  Buckets of over ``block_rows`` are compared in blocks.
    """
    differs = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    size = words * BITS
    radius = int(size * differs + 2 * (size * differs * (1 - differs)) ** 0.5)
    fps = saved(wide_fingerprints(docs, shingle, words).withColumn("id", F.xxhash64("fp", "few")), "simhash-wide")
    nodes = saved(fps.select("id", "fp", "few").dropDuplicates(["id"]), "simhash-wide-distinct")
    distinct = nodes.where((F.col("few").isNull()) | (F.length("few") >= 8 * int(np.ceil(similarity * (SHORT + 1) - 1e-9)))).select("id", "fp")
    both = np.zeros((words, BITS, BITS))
    for ij, n in distinct.select("fp").mapInArrow(tk.tidy(_wide_bit_counts(words)), "ij long, n long").groupBy("ij").sum("n").collect():
        w, i, j = ij // BITS // BITS, ij // BITS % BITS, ij % BITS
        both[w, i, j] = both[w, j, i] = n
    plan = plan_recall(distinct.count(), both, differs, recall)
    keys = distinct.mapInArrow(tk.tidy(_wide_keys(plan, words)), "bucket long, id long, fp binary")
    keys = in_blocks(keys, distinct.mapInArrow(tk.tidy(_wide_keys(plan, words, alone=True)), "bucket long"), "id", block_rows)
    found = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tk.tidy(_wide_links(words, radius)), "a long, b long")
    sets = nodes.where("few is not null").select("id", "few").mapInArrow(tk.tidy(_short_keys(similarity)), "bucket long, id long, few binary")
    sets = in_blocks(sets, sets.select("bucket"), "id", block_rows)
    found = found.union(sets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tk.tidy(_short_links(similarity)), "a long, b long"))
    roots = components(saved(found.distinct(), "simhash-wide-links"))
    rows = fps.select("doc_id", "key", "id").join(roots, F.col("id") == F.col("node"), "left").select("doc_id", "key", F.coalesce("root", "id").alias("root"))
    rows = saved(rows, "simhash-roots")
    low = saved(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("low")), "simhash-lows")
    return rows.join(low, "root").select("doc_id", "key", "low")


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, **params) -> DataFrame:
    """(doc_id, component_id) of all rows: the smallest doc_id of those that ``similar_texts`` links."""
    return similar_texts(docs, shingle, similarity, **params).select("doc_id", F.col("low.doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, **params) -> DataFrame:
    """One document of each component of similar documents, with all its columns: that of smallest doc_id.

    A null doc_id comes after all others; of rows that share a doc_id the one
    whose text has the least MD5 comes first, and of rows that share both (null
    and empty texts are alike) any one stays.
    """
    rows = saved(similar_texts(docs.select("doc_id", "text"), shingle, similarity, **params), "simhash-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key").eqNullSafe(F.col("low"))
    doc, key = (free_name(docs.columns, c) for c in ("simhash_doc", "simhash_key"))
    named = lambda df: df.select(F.col("doc_id").alias(doc), F.col("key").alias(key))
    gone = saved(named(rows.where(~first)).distinct(), "simhash-gone")
    again = saved(named(rows.where(first).groupBy("doc_id", "key").count().where("count > 1")), "simhash-again")
    own = docs["doc_id"].cast("long")

    def same(other: DataFrame) -> F.Column:
        return own.eqNullSafe(other[doc]) & (text_key(docs["text"]) == other[key])

    out = docs.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return out
    twice = out.join(again, same(again), "left_semi").withColumn(key, text_key(F.col("text"))).dropDuplicates(["doc_id", key]).drop(key)
    return out.join(again, same(again), "left_anti").union(twice)
