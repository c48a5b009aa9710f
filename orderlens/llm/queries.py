"""Registered queries of this subpackage: one thin ``opN_<name>`` per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from orderlens.llm.common import table
from orderlens.llm.decontaminate import benchmark_overlaps
from orderlens.llm.exact_dedup import exact_dedup
from orderlens.llm.language_id import language_predictions
from orderlens.llm.line_dedup import line_dedup
from orderlens.llm.merkle import fold, leaf_digest, merkle_proofs, proof_digest
from orderlens.llm.minhash import near_duplicates
from orderlens.llm.packing import best_fit_packing
from orderlens.llm.quality import quality_predictions
from orderlens.llm.repeat_spans import repeat_spans
from orderlens.llm.substring_dedup import substring_dedup
from orderlens.llm.token_align import token_alignment
from orderlens.llm.token_counts import section_token_counts
from orderlens.llm.url_filter import judge_urls

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# The url rules of the query
ALLOWED = [("com", "/"), ("www.example.com", "/en/")]
BLOCKED = [("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), ALLOWED, BLOCKED)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_token_counts(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id's crc32 divides by 3 are presented with the A-Z of their text lower-cased (null ids: unchanged)."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    shown = leaf_digest([text if c == "text" else F.col(c) for c in LEAF_FIELDS])
    rows = merkle_proofs(table(spark, sf_dir, "documents"), "doc_id", "lang", LEAF_FIELDS, {"shown": shown})
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                       fold(F.col("shown"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No document has a smaller id than one without an id, and that one's is smaller than none."""
    return repeat_spans(table(spark, sf_dir, "documents"), null_last=False)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_best_fit_packing, op3_quality_classifier, op4_benchmark_decontamination, op5_exact_dedup, op6_url_filter,
        op7_token_counts, op8_minhash_near_dedup, op9_language_id, op10_line_dedup, op11_merkle_manifest,
        op12_suffix_array_dedup, op13_token_alignment)}
