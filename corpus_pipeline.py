"""Corpus pipeline: the stages that turn ``documents`` into packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns a DataFrame; between stages the rows are written as Parquet and read
again. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orderlens.llm.common import materialize, table
from orderlens.llm.decontaminate import without_contaminated
from orderlens.llm.exact_dedup import keep_first_texts
from orderlens.llm.minhash import keep_one_of_each
from orderlens.llm.packing import best_fit_packing
from orderlens.llm.quality import accepted

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of equal texts."""
    return keep_first_texts(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with the sequence and offset each one takes."""
    return best_fit_packing(docs, WORD_BPE)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

# The classifier, the signatures and the tokenizer have no SQL form; tests/llm holds the stages' rows against expected ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
