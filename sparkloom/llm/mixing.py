"""Mixing sources to target weights.

Sources, by code point and null last, weigh 1, 2, 3, repeating.  Capped
water-filling shares all words by weight, holds each source at ``epochs`` times
its size and reshares the excess by weight until no source is above its cap:
with the sources ordered by cap per unit of weight, the level after the first i
are held is (total - their caps) / (weight left), and the final level is the
largest of these.  A source then repeats whole, and the fractional repetition
takes documents in seeded hash order until the target is reached; the document
at the cut gives a part of its words.

The cut is found from sums per (source, hash prefix), so no task orders a whole
source, and only one row per source is joined back to the documents.

Defined cases: null text has no words; a source without words has target 0;
repeated rows count each by itself and those at a cut (also those of one doc_id,
whose hashes tie) share it evenly; a null doc_id hashes as 'null'; a long text is
counted whole and may be cut; an empty table gives an empty result; further
columns, whatever their names, are not read by ``mix`` and are kept by
``mixed_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import textkit as tk
from sparkloom.llm.shared import free_name, saved


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.text_slices(batch):
            data, offs = tk.flat(part.column("text"))
            firsts = tk.words(data, offs, tk.SPACE_WORDS)[2]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(np.diff(firsts).astype(np.int64))], ["doc_id", "source", "size"])


def _order_key(seed: int) -> F.Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))


def document_sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, size in words and the seeded order key, written once."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(tk.tidy(_sizes), "doc_id long, source string, size long")
    return saved(slim.withColumn("h", _order_key(seed)), "mix-sizes")


def source_targets(sizes: DataFrame, epochs: int = 3) -> DataFrame:
    """One row per source: source_size, target, whole repetitions and the words the fractional one takes."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("w", (rank - 1) % 3 + 1).withColumn("cap", epochs * F.col("source_size"))
    held = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(held), F.lit(0))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(held), F.lit(0))) / left
    by = by.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    by = by.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return by.withColumn("whole", times).withColumn("want", F.greatest(F.lit(0), F.floor("target") - F.col("whole") * F.col("source_size"))).select("source", "source_size", "target", "whole", "want")


def mixing_plan(sizes: DataFrame, epochs: int = 3) -> DataFrame:
    """source_targets with the cut: the hash up to which documents join the fractional repetition, and its words there."""
    targets = saved(source_targets(sizes, epochs), "mix-targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    prefix = F.substring("h", 1, 3)
    sums = sizes.groupBy("source", prefix.alias("p")).agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("n").over(upto))
    edge = sums.join(targets, same(sums, targets)).where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("n") <= F.col("want"))).select(sums["source"].alias("s"), F.col("p").alias("edge"), (F.col("want") - F.col("upto") + F.col("n")).alias("rest"))
    edge = saved(edge, "mix-edges")
    near = sizes.join(edge, sizes["source"].eqNullSafe(edge["s"]) & (F.substring(sizes["h"], 1, 3) == edge["edge"]))
    near = near.groupBy("s", "rest", "h").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    upto = Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    cut = near.withColumn("upto", F.sum("n").over(upto)).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("n") <= F.col("rest")))
    cut = cut.select(F.col("s").alias("cs"), F.col("h").alias("cut"), F.floor((F.col("rest") - F.col("upto") + F.col("n")) / F.col("rows")).alias("part"))
    return saved(targets.join(cut, targets["source"].eqNullSafe(cut["cs"]), "left").drop("cs"), "mix-plan")


def _taken(h: F.Column) -> F.Column:
    extra = F.when(h < F.col("cut"), F.col("size")).when(h == F.col("cut"), F.least(F.col("size"), F.col("part"))).otherwise(F.lit(0))
    return (F.col("whole") * F.col("size") + extra).cast("long")


def mix(docs: DataFrame, epochs: int = 3, seed: int = 7) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    sizes = document_sizes(docs, seed)
    plan = mixing_plan(sizes, epochs).withColumnRenamed("source", "s")
    out = sizes.join(plan, sizes["source"].eqNullSafe(plan["s"]), "left")
    return out.select("doc_id", "size", "source_size", "target", _taken(F.col("h")).alias("taken"))


def mixed_documents(docs: DataFrame, epochs: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies, and at each cut a text of its first words."""
    sizes = document_sizes(docs, seed)
    plan = mixing_plan(sizes, epochs)
    name = {c: free_name(docs.columns, f"mix_{c}") for c in ("source", "whole", "cut", "part", "times", "words")}
    plan = plan.select(*(F.col(c).alias(name[c]) for c in ("source", "whole", "cut", "part")))
    h, cut = _order_key(seed), F.col(name["cut"])
    times = F.col(name["whole"]) + F.when(h < cut, 1).otherwise(0)
    words = F.when(h == cut, F.col(name["part"])).otherwise(0)
    out = docs.join(plan, docs["source"].eqNullSafe(plan[name["source"]]), "left").select(*(docs[c] for c in docs.columns), times.alias(name["times"]), words.alias(name["words"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index("text")
        for batch in batches:
            times = batch.column(name["times"]).to_numpy(zero_copy_only=False).astype(np.int64)
            plain = batch.select(docs_columns)
            yield plain.take(pa.array(np.repeat(np.arange(times.size), times)))
            for row in np.flatnonzero(batch.column(name["words"]).to_numpy(zero_copy_only=False)):
                one = plain.slice(row, 1)
                data, offs = tk.flat(one.column("text"))
                starts, ends, _ = tk.words(data, offs, tk.SPACE_WORDS)
                n = min(ends.size, batch.column(name["words"])[int(row)].as_py())
                if n:
                    arrays = list(one.columns)
                    text = data[: ends[n - 1]].tobytes().decode()
                    arrays[at] = pa.array([text], one.schema.field(at).type)
                    if "n_chars" in docs_columns and pa.types.is_integer(one.schema.field("n_chars").type):
                        arrays[docs_columns.index("n_chars")] = pa.array([len(text)], one.schema.field("n_chars").type)
                    yield pa.RecordBatch.from_arrays(arrays, schema=one.schema)

    docs_columns = docs.columns
    return out.mapInArrow(tk.tidy(run), docs.schema)
