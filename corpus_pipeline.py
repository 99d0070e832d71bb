"""A training-corpus pipeline: toxicity, near-dedup, substring dedup, mixing, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on everything its
predecessor kept; ``run`` writes each stage's rows as Parquet to the shared
folder and reads them back as the next stage's documents; what no later stage
reads is deleted.

Defined cases, in the stages' modules at length: null and empty texts stay in
until near-dedup, where they form one group; rows without a doc_id stay distinct
from others; repeated rows are one document from near-dedup on; equal texts go
to the smallest doc_id; long texts are handled whole in every stage; columns that
the stages don't know, whatever their names, are carried to the last; an empty
table runs through and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import mixing, packing, simhash, substring_dedup, toxicity
from sparkloom.llm.queries import tokenizer_path
from sparkloom.llm.shared import discard, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones among them, doesn't reject."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of similar ones: shingles of five words, similarity 0.8."""
    return simhash.deduplicated(docs, shingle=5, similarity=0.8)


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur elsewhere too."""
    return substring_dedup.without_repeats(docs, length=200)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, and at each source's cut one text shortened, to the sources' targets."""
    return mixing.mixed_documents(docs, epochs=3)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places in windows of 2048."""
    return packing.pack(docs, tokenizer_path(), window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_substrings),
    ("source_mixing", mix_sources),
    ("packing", pack_windows),
]

#: Hashes, a fitted classifier and a tokenizer decide here; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
