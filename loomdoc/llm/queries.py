"""The queries of this subpackage: name -> (spark, table folder) -> DataFrame, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import avi, bpe, decontaminate, line_dedup, mixing, neardup, oracles, prefix_trie, quality, secrets_scan, spelling, substring_dedup, toxicity, warc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.digest(table(spark, folder, "documents"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(table(spark, folder, "documents"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.digest(table(spark, folder, "pages"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.digest(table(spark, folder, "documents"))


def op6_avi(spark: SparkSession, folder: str) -> DataFrame:
    return avi.digest(table(spark, folder, "documents"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(table(spark, folder, "documents"))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.digest(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets_scan.digest(table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.digest(table(spark, folder, "conversations"))


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest(table(spark, folder, "documents"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.digest(table(spark, folder, "documents"))


def avi_payload(spark: SparkSession, folder: str) -> DataFrame:
    """What op6 reads back, without what depends on the container."""
    return op6_avi(spark, folder).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def secret_base_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The spans of op10 that its patterns alone decide."""
    return op10_secrets(spark, folder).drop("spans")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_minhash, op2_substring_dedup, op3_quality, op4_warc, op5_mixing, op6_avi, op7_line_dedup, op8_decontaminate, op9_toxicity, op10_secrets, op11_prefix_trie, op12_bpe, op13_spelling, avi_payload, secret_base_spans, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
