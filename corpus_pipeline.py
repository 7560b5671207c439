"""The corpus pipeline: rules, line and near-duplicate removal, mixing and packing of ``documents``, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from batchloom.llm.common import store
from batchloom.llm.linededup import drop_common_lines
from batchloom.llm.mixing import take_mix
from batchloom.llm.nearcopies import drop_near_copies
from batchloom.llm.packing import best_fit_packing
from batchloom.llm.quality import apply_quality
from batchloom.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and too frequent lines of the others."""
    return apply_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go from the later one; every document stays."""
    return drop_common_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates stays."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that sources come near their target weights."""
    return take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024."""
    return best_fit_packing(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

ORACLE_SQL = None  # fingerprints, alignment and tokens have no SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
