"""Language-model scores from a log-frequency Bloom filter.

Counts of all words and word pairs are gathered over the whole training part:
batches send their distinct n-grams with counts to shards by hash.  Each shard
quantises counts on a logarithmic scale and stores an n-gram of level q as q
events in its segment of a Bloom filter, ``bits`` for each event.  A lookup
probes the events 1, 2, ... until one is absent.  Shards look up what batches
sent, held-out text's n-grams too, and answer with levels.  No n-gram is left
out, so the filter grows with the corpus; that is why its segments stay where
the shards are, and what is broadcast in the textbook form is asked for instead.

With c(h, w) the count that stands for the pair's level, M(h) the sum of these
over the history's pairs and T(h) their number,

    P(w | h) = (c(h, w) + T(h) P(w)) / (M(h) + T(h)),  P(w) = (c(w) + 0.1) / total,

so that the probabilities after a history sum to 1 over the words and one
unknown word.  M and T are taken over looked-up levels: a level that the filter
overstates is in its history's sum too, and only pairs that were never stored
can add mass, each with the filter's error rate (about ``2 ** -PROBES`` at the
default size).  Histories are told apart by the upper 32 bits of their hash, the
words after one history by the upper 32 bits of theirs.

A pair's shard adds up its part of each history and sends it to the history's
shard, so the pairs of one frequent word are spread over all shards.  A batch
sends a shard one row, if any: never more rows than it has distinct n-grams.
Exact word counts for the base score go back with the levels, so the vocabulary
is never collected or broadcast.

Defined cases: null and empty texts are the end token alone; a null doc_id is
training text; repeated rows score equally and count each; equal counts get
equal levels; without training text all counts are 0; a long text is read in
whole, within the memory of its batch; empty tables give empty results; columns
other than doc_id and text (and those of ``held_out``) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import textkit as tk
from sparkloom.llm.batches import SMALL_PAGES, answered, batch_table, by_shard, doc_slices, from_bytes
from sparkloom.llm.shared import input_bytes, saved

END = tk.mix(np.array([0x656E64], tk.U))
PROBES, LOG_BASE, MAX_LEVEL = 11, 1.5, 64
_LOWEST = np.ceil(LOG_BASE ** np.arange(MAX_LEVEL + 1))  # least count of level q + 1
_SALT = tk.mix(np.arange(1, (MAX_LEVEL + 2) * PROBES + 1, dtype=tk.U)).reshape(-1, PROBES)
_BLOCK = 1 << 17  # n-grams that are hashed at a time: temporary arrays have this size, not a batch's


def levels(counts: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log(count))."""
    return np.minimum(np.searchsorted(_LOWEST, counts, "right"), MAX_LEVEL)


def level_counts() -> np.ndarray:
    """The count that stands for each level: the geometric middle of its range."""
    low = _LOWEST[:-1]
    high = np.maximum(_LOWEST[1:] - 1, low)
    return np.concatenate([[0.0], np.sqrt(low * high)])


class LogFilter:
    """Bloom filter of (n-gram, level) events in segments by hash range."""

    def __init__(self, bits: np.ndarray, starts: np.ndarray):
        self.bits, self.starts = bits, starts  # starts: first bit of each segment, and the end

    @staticmethod
    def spots(h: np.ndarray, level: int, probe: int, start, size) -> np.ndarray:
        x = tk.mix(h ^ _SALT[level, probe]) >> np.uint64(32)
        return (x * np.asarray(size, tk.U) >> np.uint64(32)).astype(np.int64) + start

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram: how many events in a row are present."""
        return np.concatenate([self._lookup(h[a : a + _BLOCK]) for a in range(0, h.size, _BLOCK)]) if h.size else np.zeros(0, np.uint8)

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        segment = ((h >> np.uint64(32)).astype(np.int64) * (self.starts.size - 1)) >> 32
        start, size = self.starts[segment], np.diff(self.starts)[segment]
        out = np.zeros(h.size, np.uint8)
        alive = np.flatnonzero(size > 0)
        for level in range(1, MAX_LEVEL + 1):
            for probe in range(PROBES):
                at = self.spots(h[alive], level, probe, start[alive], size[alive])
                alive = alive[self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0]
            if not alive.size:
                break
            out[alive] = level
        return out


def segment(word: np.ndarray, word_level: np.ndarray, pair: np.ndarray, pair_level: np.ndarray, most_bits: int, bits: float) -> np.ndarray:
    """A segment's bytes: all words and pairs of level 1 or more."""
    events = int(word_level.sum(dtype=np.int64)) + int(pair_level.sum(dtype=np.int64))
    size = -(-int(events * bits) // 8) * 8
    if size > most_bits:
        raise ValueError(f"{events} events need {size} bits, over the {most_bits} of a segment; use more shards")
    out = np.zeros(size, bool)
    for grams, their_levels in ((word, word_level), (pair, pair_level)):
        for a in range(0, grams.size, _BLOCK):
            h, level = grams[a : a + _BLOCK], their_levels[a : a + _BLOCK]
            for k in range(1, int(level.max(initial=0)) + 1):
                h, level = h[level >= k], level[level >= k]
                for probe in range(PROBES):
                    out[LogFilter.spots(h, k, probe, 0, size)] = True
    return np.packbits(out, bitorder="little")


_UPPER = np.uint64(0xFFFFFFFF00000000)


def _tokens(docs: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a batch, the words of each text and its end, and each text's number of them."""
    tokens, sizes = [np.zeros(0, tk.U)], [np.zeros(0, np.int64)]
    for _, part in doc_slices(docs):
        data, offs = tk.flat(part.column("text"))
        data = tk.LOWER[data]
        starts, ends, firsts = tk.words(data, offs, tk.SPACE_WORDS)
        tokens.append(np.insert(tk.word_hashes(data, starts, ends), firsts[1:], END[0]))
        sizes.append(np.diff(firsts) + 1)
    return np.concatenate(tokens), np.concatenate(sizes)


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Each token after the one before it, and the first after an end."""
    out = np.empty(tokens.size, tk.U)
    out[:1], out[1:] = END, tokens[:-1]
    out &= _UPPER
    out |= tokens >> np.uint64(32)
    return out


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, np.int64)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs; ``keys`` are sorted in place."""
    keys.sort()
    n = _heads(keys)
    found = keys[n]
    n[:-1] = n[1:] - n[:-1]
    n[-1:] = keys.size - n[-1:]
    return found, n


def _distinct_train(keys: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs where ``held`` is false; ``keys`` are sorted in place."""
    others, less = _distinct(keys[held])
    found, n = _distinct(keys)
    n[np.searchsorted(found, others)] -= less
    return found, n


def _merged(blobs: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of squeezed lists with the sums of their counts; a list has a key once."""
    found, n = _distinct(np.concatenate([_unsqueeze(x)[0] for x in blobs]))
    for x in blobs:
        keys, counts = _unsqueeze(x)
        many = np.flatnonzero(counts != 1)
        n[np.searchsorted(found, keys[many])] += counts[many] - 1
    return found, n


def _squeeze(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys, and the counts that aren't 1."""
    many = np.flatnonzero(counts != 1)
    return np.array([keys.size, many.size], "<i8").tobytes() + keys.tobytes() + counts[many].astype("<i8").tobytes() + many.astype("<u4").tobytes()


def _unsqueeze(blob: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    n, many = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(blob, "<u4", many, 16 + 8 * (n + many))] = np.frombuffer(blob, "<i8", many, 16 + 8 * n)
    return np.frombuffer(blob, tk.U, n, 16), counts


def _pair_parts(pairs: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted pairs: an order by shard that keeps pairs sorted, the shards that occur and the bounds of each."""
    shard = np.empty(pairs.size, np.uint16 if shards <= 1 << 16 else np.uint32)
    for a in range(0, pairs.size, _BLOCK):
        shard[a : a + _BLOCK] = (tk.mix(pairs[a : a + _BLOCK]) >> np.uint64(32)).astype(np.int64) * shards >> 32
    sizes = np.bincount(shard, minlength=shards)
    occur = np.flatnonzero(sizes)
    return np.argsort(shard, kind="stable"), occur, np.append(0, np.cumsum(sizes[occur]))


_SENT = "shard long, bid long, words binary, pairs binary"


def _counts(shards: int):
    """What a batch sends to each shard: its distinct words and pairs with their counts in training text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, rows in zip(batch.column("bid").to_pylist(), batch.column("rows"), strict=True):
                docs = from_bytes(rows.as_buffer())
                words, sizes = _tokens(docs)
                if not words.size:
                    continue
                held = np.repeat(docs.column("held_out").to_numpy(zero_copy_only=False), sizes)
                del docs
                tk.release()
                pair, pair_n = _distinct_train(_pairs(words), held)
                word, word_n = _distinct_train(words, held)
                del words, held
                tk.release()
                shard, cuts = by_shard(word, shards)
                of_word = dict(zip(shard.tolist(), zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), strict=True))
                order, shard, cuts = _pair_parts(pair, shards)
                of_pair = dict(zip(shard.tolist(), zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), strict=True))
                for shard in sorted(of_word.keys() | of_pair.keys()):
                    a, b = of_word.get(shard, (0, 0))
                    c, d = of_pair.get(shard, (0, 0))
                    own = order[c:d]
                    yield pa.RecordBatch.from_pydict({"shard": [shard], "bid": [bid], "words": [_squeeze(word[a:b], word_n[a:b])], "pairs": [_squeeze(pair[own], pair_n[own])]})

    return run


_MOST_BITS = 1 << 32  # what LogFilter.spots can address
_TALLY = "kind string, shard long, bid long, words binary, word_n binary, word_levels binary, pair_levels binary, tokens long, vocabulary long, mass double"
#: One history's part from a shard: the upper half of its hash, the sum of its pairs' counts and their number.
_PART = np.dtype([("history", "<u8"), ("mass", "<f8"), ("kinds", "<i8")])


def _tally(bits: float, shards: int):
    """One shard: levels of what each batch sent, in its order; parts of histories for their shards; totals."""

    def run(table: pa.Table) -> pa.Table:
        tk.release()
        out = tallied(table)
        tk.release()
        return out

    def tallied(table: pa.Table) -> pa.Table:
        sent, squeezed = ([x.as_buffer() for x in table.column(c)] for c in ("words", "pairs"))
        (word, word_n), (pair, pair_n) = _merged(sent), _merged(squeezed)
        piece = segment(word, levels(word_n), pair, levels(pair_n), _MOST_BITS, bits)
        model = LogFilter(np.append(piece, np.uint8(0)), np.array([0, 8 * piece.size]))
        word_found, pair_found = model.lookup(word), model.lookup(pair)
        stands, n, shard = level_counts(), table.num_rows, table.column("shard")[0].as_py()
        stored = pair_n > 0
        history = pair[stored]
        history &= _UPPER
        heads = _heads(history)
        parts = np.zeros(heads.size, _PART)
        if heads.size:
            parts["history"], parts["mass"] = history[heads], np.add.reduceat(stands[pair_found[stored]], heads)
            parts["kinds"] = np.diff(heads, append=history.size)
        to, cuts = by_shard(parts["history"], shards)
        del stored, history, pair_n
        asked_words = [_unsqueeze(x)[0] for x in sent]
        places = [np.searchsorted(word, x) for x in asked_words]
        asked = {
            "kind": ["word"] * n,
            "shard": [shard] * n,
            "bid": table.column("bid").to_pylist(),
            "words": [x.tobytes() for x in asked_words],
            "word_n": [word_n[at].tobytes() for at in places],
            "word_levels": [word_found[at].tobytes() for at in places],
        }
        answers = {"kind": ["pair"] * n, "shard": [shard] * n, "bid": asked["bid"], "pair_levels": [pair_found[np.searchsorted(pair, _unsqueeze(x)[0])].tobytes() for x in squeezed]}
        sums = {"kind": ["part"] * to.size, "shard": to.tolist(), "words": [parts[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]}
        total = {"kind": ["total"], "tokens": [int(word_n.sum())], "vocabulary": [int((word_n > 0).sum())], "mass": [float(stands[word_found[word_n > 0]].sum())]}
        schema = _arrow(_TALLY)
        return pa.concat_tables(pa.table({f.name: pa.array(x.get(f.name, [None] * len(x["kind"])), f.type) for f in schema}, schema=schema) for x in (asked, answers, sums, total))

    return run


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))])


_WORDS = "shard long, bid long, word_n binary, word_levels binary, mass binary, kinds binary"


def _histories(key: tuple, asked: pa.Table, parts: pa.Table) -> pa.Table:
    """One shard of words: what batches asked for, with the sums over each word's pairs."""
    tk.release()
    sums = np.frombuffer(b"".join(x.as_py() for x in parts.column("sums")), _PART)
    sums = sums[np.argsort(sums["history"], kind="stable")]
    heads = _heads(sums["history"])
    history = np.append(sums["history"][heads], np.uint64(0))
    mass, kinds = (np.append(np.add.reduceat(sums[c], heads) if heads.size else sums[c], 0) for c in ("mass", "kinds"))
    out: dict[str, list] = {"shard": [], "bid": [], "word_n": [], "word_levels": [], "mass": [], "kinds": []}
    for row in asked.to_pylist():
        own = np.frombuffer(row["words"], tk.U) & _UPPER
        at = np.minimum(np.searchsorted(history[:-1], own), heads.size)
        at[history[at] != own] = heads.size
        for c, x in (("shard", row["shard"]), ("bid", row["bid"]), ("word_n", row["word_n"]), ("word_levels", row["word_levels"]), ("mass", mass[at].astype("<f8").tobytes()), ("kinds", kinds[at].astype("<i8").tobytes())):
            out[c].append(x)
    return pa.table(out, schema=_arrow(_WORDS))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, held_out: F.Column | None = None, bits: float = 16.0, shard_bytes: int = 8 << 20) -> DataFrame:
    """Score every document with the model of those that aren't held out."""
    out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0 if held_out is None else held_out
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(out, F.lit(False)).alias("held_out"))
    batches = batch_table(slim, "lm-batches", compression="none", **SMALL_PAGES)  # its rows are compressed
    shards = max(8, input_bytes(batches) // shard_bytes)
    sent = batches.mapInArrow(tk.tidy(_counts(shards)), _SENT)
    tally = saved(sent.groupBy("shard").applyInArrow(_tally(bits, shards), _TALLY), "lm-tally", **SMALL_PAGES)
    tokens, vocabulary, mass = (x or 0 for x in tally.where("kind = 'total'").agg(F.sum("tokens"), F.sum("vocabulary"), F.sum("mass")).first())
    total, model_total = tokens + 0.1 * (vocabulary + 1), mass + 0.1 * (vocabulary + 1)
    asked, parts = tally.where("kind = 'word'").select("shard", "bid", "words", "word_n", "word_levels"), tally.where("kind = 'part'").select(F.col("shard").alias("to"), F.col("words").alias("sums"))
    words = asked.groupBy("shard").cogroup(parts.groupBy("to")).applyInArrow(_histories, _WORDS)
    levels_of = tally.where("kind = 'pair'").select("shard", "bid", "pair_levels")
    answers = words.withColumn("pair_levels", F.lit(None).cast("binary")).unionByName(levels_of, allowMissingColumns=True)

    def run(bid: int, rows: pa.RecordBatch, found: pa.Table) -> list[pa.Table]:
        out = scored(rows, found)
        tk.release()
        return out

    def scored(rows: pa.RecordBatch, found: pa.Table) -> list[pa.Table]:
        stands = level_counts()
        by = np.argsort(found.column("shard").to_numpy(), kind="stable").tolist()

        def answer(name: str, kind: str) -> np.ndarray:
            blobs = found.column(name)
            return np.frombuffer(b"".join(x for k in by if (x := blobs[k].as_py()) is not None), kind)

        token, sizes = _tokens(rows)
        tk.release()
        if not sizes.size:
            return []
        pairs, word = _distinct(_pairs(token))[0], _distinct(token.copy())[0]
        pair_levels = np.zeros(pairs.size, np.uint8)
        pair_levels[_pair_parts(pairs, shards)[0]] = answer("pair_levels", "u1")
        tk.release()
        counts, mass, kinds = answer("word_n", "<i8"), answer("mass", "<f8"), answer("kinds", "<i8")
        log_base = np.log10((counts + 0.1) / total)
        p_word = (stands[answer("word_levels", "u1")] + 0.1) / model_total
        end, firsts = int(np.searchsorted(word, END[0])), np.append(0, np.cumsum(sizes))
        n_known, base, score, a = np.zeros(sizes.size, np.int64), np.zeros(sizes.size), np.zeros(sizes.size), 0
        while a < sizes.size:  # some texts at a time, each after an end
            b = max(a + 1, int(np.searchsorted(firsts, firsts[a] + _BLOCK, "right")) - 1)
            own, first = token[firsts[a] : firsts[b]], firsts[a : b + 1] - firsts[a]
            at = np.searchsorted(word, own)
            before = np.append(end, at[:-1])
            joint, kind = stands[pair_levels[np.searchsorted(pairs, _pairs(own))]], kinds[before]
            seen = kind > 0
            logs = np.log10(np.where(seen, (joint + kind * p_word[at]) / np.where(seen, mass[before] + kind, 1), p_word[at]))
            n_known[a:b] = tk.per_doc(counts[at] > 0, first)
            base[a:b], score[a:b] = np.add.reduceat(log_base[at], first[:-1]), np.add.reduceat(logs, first[:-1])
            a = b
        columns = {"n_tokens": sizes.astype(np.int64), "n_known": n_known, "train_tokens": np.full(sizes.size, tokens, np.int64), "base_score": base, "score": score}
        return [pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out")} | {c: pa.array(x) for c, x in columns.items()})]

    return answered(batches, answers, run, SCORES)
