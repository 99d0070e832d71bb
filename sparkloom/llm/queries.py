"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import licenses, lm, media, mixing, packing, quality_classifier, quality_rules, simhash, substring_dedup, toxicity
from sparkloom.llm.oracles import ORACLES


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": lambda spark, d: toxicity.score_documents(_docs(spark, d), _labels(spark, d)),
    "op2_media_columns": lambda spark, d: media.media_round_trip(_docs(spark, d)),
    "op3_lm_scoring": lambda spark, d: lm.score_documents(_docs(spark, d)),
    "op4_packing": lambda spark, d: packing.pack(_docs(spark, d), tokenizer_path()),
    "op5_simhash_near_dedup": lambda spark, d: simhash.near_duplicates(_docs(spark, d)),
    "op6_source_mixing": lambda spark, d: mixing.mix(_docs(spark, d)),
    "op7_substring_dedup": lambda spark, d: substring_dedup.removal_report(_docs(spark, d)),
    "op8_quality_classifier": lambda spark, d: quality_classifier.score_documents(_docs(spark, d), _labels(spark, d)),
    "op9_license_scan": lambda spark, d: licenses.scan(_docs(spark, d)),
    "op10_quality_rules": lambda spark, d: quality_rules.quality_metrics(_docs(spark, d)),
}
ORACLE_SQL = {k: v for k, v in ORACLES.items() if k in QUERIES}
