"""Queries ``opN_<name>`` over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fingerprints, langid, licenses, line_dedup, ngram_join, snapshot_diff, token_store, topk_search, toxicity, whitening
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 9))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_format(table(spark, sf_dir, "conversations"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.build_store(table(spark, sf_dir, "documents"), tokenizer_path()).read(spark)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digest(table(spark, sf_dir, "documents"))


def op13_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff.snapshot_diff(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_decontaminate": op2_decontaminate,
        "op3_licenses": op3_licenses,
        "op4_ngram_join": op4_ngram_join,
        "op5_chat": op5_chat,
        "op6_line_dedup": op6_line_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_token_store": op8_token_store,
        "op9_topk": op9_topk,
        "op10_language": op10_language,
        "op11_whitening": op11_whitening,
        "op12_fingerprints": op12_fingerprints,
        "op13_snapshot_diff": op13_snapshot_diff,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": licenses.oracle(), "op4_ngram_join": ngram_join.ORACLE, "op5_chat": chat.ORACLE, "op9_topk": topk_search.ORACLE, "op13_snapshot_diff": snapshot_diff.ORACLE}
