"""License scans by diagonal voting.

All rolling word 3-grams of all texts are joined to the positions of the same
3-grams in license texts and notices.  A match at word i of a text and word j of
a template votes for the diagonal i - j; votes are counted by diagonal, and
diagonals within ``shift`` of each other merge to a span (words put in or left
out move a match to the next ones).  A span is verified by the template's own
order: what counts are the template's 3-grams that stand in it one after the
other, each once, as the longest chain of matches that rises in both texts.
The span gives its label when this chain holds ``share`` of the template, or all
of one below ten 3-grams.  ``score`` is the largest share of a chain.

The template table is broadcast while it is small (the built-in one has under
2,000 rows); beyond ``BROADCAST_ROWS`` Spark joins it as it sees fit.

Base phrases count where every 3-gram votes on one diagonal, that is, where
their words stand in a row.

Each document also sends one mark that always joins, so documents without a
match keep their row and everything comes from one pass over the texts.  What a
text sends is dealt by row, so a phrase or source that many documents share is
nowhere gathered.

Defined cases: null and empty texts have no words, no places, empty labels and
score 0; repeated rows are told apart by a row number and get equal results;
phrases that overlap count each; of spans with equal chains any gives the same
label and score; a long text is scanned whole, and all its matches meet in one
task; empty tables give empty results; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm import textkit as tk
from sparkloom.llm.license_texts import LINES, TEXTS

GRAM = 3
BROADCAST_ROWS = 100_000
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (*TEXTS, *LINES)
_MARK = 0


def _grams_of(text: str) -> np.ndarray:
    data, offs = tk.flat(pa.array([text]))
    data = tk.LOWER[data]
    starts, ends, firsts = tk.words(data, offs, tk.ALNUM_WORDS)
    return tk.grams(tk.word_hashes(data, starts, ends), firsts, GRAM)[0].view(np.int64)


def template_positions(spark: SparkSession, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(h, template, at, label, grams, base): where each 3-gram stands in each template; grams is the template's number."""
    rows = [(_MARK, -1, 0, None, 0, False)]
    for k, (label, text, base) in enumerate([*((a, b, True) for a, b in BASE), *((a, b, False) for a, b in templates)]):
        grams = _grams_of(text).tolist()
        rows += [(h, k, at, label, len(grams), base) for at, h in enumerate(grams)]
    out = spark.createDataFrame(rows, "h long, template int, at int, label string, grams int, base boolean")
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def chain(pos: list[int], at: list[int]) -> int:
    """Length of the longest chain of matches that rises strictly in text and template."""
    ends: list[int] = []
    for _, neg in sorted(zip(pos, (-x for x in at), strict=True)):  # of one place in the text at most one match joins
        k = bisect_left(ends, -neg)
        ends[k : k + 1] = [-neg]
    return len(ends)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans with ``chain`` in place of their matches."""
    for batch in batches:
        hits, base = batch.column("hits"), batch.column("base").to_numpy(zero_copy_only=False)
        bounds, pos, at = hits.offsets.to_numpy(), hits.values.field("pos").to_numpy(), hits.values.field("at").to_numpy()
        sizes = np.diff(bounds)
        out = sizes.astype(np.int64)
        for k in np.flatnonzero((sizes > 1) & ~base).tolist():
            a, b = bounds[k], bounds[k + 1]
            out[k] = chain(pos[a:b].tolist(), at[a:b].tolist())
        columns = [c for c in batch.schema.names if c != "hits"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out)], [*columns, "chain"])


def _rolling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in tk.text_slices(batch):
            data, offs = tk.flat(part.column("text"))
            data = tk.LOWER[data]
            starts, ends, firsts = tk.words(data, offs, tk.ALNUM_WORDS)
            g, at = tk.grams(tk.word_hashes(data, starts, ends), firsts, GRAM)
            n = part.num_rows
            sizes = np.maximum(np.diff(firsts) - GRAM + 1, 0)
            heads = np.append(0, np.cumsum(sizes + 1))
            values = np.full(heads[-1], _MARK, np.int64)
            inside = np.ones(heads[-1], bool)
            inside[heads[1:] - 1] = False
            values[inside] = g.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column("doc_id"), pa.array(np.diff(firsts).astype(np.int64)), lists], ["rid", "doc_id", "n_words", "hs"])
            row += n


_SPANS = "rid long, template int, label string, grams int, base boolean, at long, doc_id long, n_words long, chain long"


def scan(docs: DataFrame, share: float = 0.7, shift: int = 4, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """License places and labels of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tk.tidy(_rolling), "rid long, doc_id long, n_words long, hs array<bigint>")
    grams = texts.select("rid", "doc_id", "n_words", F.posexplode("hs").alias("pos", "h"))
    hits = grams.join(template_positions(docs.sparkSession, templates), "h").repartition("rid")
    diagonal = hits.groupBy("rid", "template", "label", "grams", "base", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "at")).alias("hits"),
        F.max(F.when(F.col("template") < 0, F.col("doc_id"))).alias("doc_id"),
        F.max("n_words").alias("n_words"),
    )
    along = Window.partitionBy("rid", "template").orderBy("diagonal")
    far = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > shift), F.lit(True))
    spans = (
        diagonal.withColumn("far", far.cast("int"))
        .withColumn("span", F.sum("far").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("rid", "template", "label", "grams", "base", "span")
        .agg(F.min("diagonal").cast("long").alias("at"), F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"))
        .drop("span")
        .mapInArrow(_verified, _SPANS)
        .withColumn("cover", F.when(F.col("template") < 0, 0.0).otherwise(F.col("chain") / F.col("grams")))
    )
    real = F.col("template") >= 0
    place = real & F.col("base") & (F.col("chain") == F.col("grams"))
    found = place | (real & ~F.col("base") & (F.col("chain") >= F.when(F.col("grams") < 10, F.col("grams")).otherwise(share * F.col("grams"))))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        spans.groupBy("rid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.count_if(place).alias("n_base"),
            F.min(F.when(place, F.col("at"))).alias("first_word"),
            F.max(F.when(place, F.col("at"))).alias("last_word"),
            joined(place).alias("base_labels"),
            joined(found).alias("labels"),
            F.max(F.when(place | (real & ~F.col("base")), F.col("cover")).otherwise(0.0)).alias("score"),
        )
        .drop("rid")
    )
