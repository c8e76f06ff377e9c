"""The numbered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.digest(_read(spark, sf_dir, "pages"), least_payload=1000)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring_dedup

    return substring_dedup.digest(_read(spark, sf_dir, "documents"), window=13)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, radius=4)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    documents = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(documents, temperature=0.5, block=64)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=13)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_counts

    return token_counts.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    return language_id.digest(_read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import license_scan

    return license_scan.scan(_read(spark, sf_dir, "documents"), threshold=0.8)


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import nearest

    return nearest.digest(_read(spark, sf_dir, "embeddings"), k=10, every=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import decontaminate, license_scan, nearest, substring_dedup, warc

    return {
        "op1_warc_index": warc.ORACLE, "op2_substring_dedup": substring_dedup.ORACLE, "op5_decontaminate": decontaminate.ORACLE,
        "op9_license_scan": license_scan.oracle(0.8), "op10_nearest_vectors": nearest.ORACLE,
    }
