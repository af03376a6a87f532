"""A training corpus from raw documents: quality, near duplicates, contamination, personal data, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's result to the shared folder as Parquet and hands it to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import decontaminate, near_duplicates, personal_data, pieces, quality
from foliospark.llm.runtime import drop_stored, free_shuffles, scratch, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged. A null text fails; columns pass through."""
    return quality.keep_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row: that with the smallest id. Texts without words stay; columns pass through."""
    return near_duplicates.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that mostly consist of them go. Columns pass through."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind. Every document stays; columns pass through."""
    return personal_data.redact(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with scores and a decoding check: doc_id, n_pieces, ids, score, second_score, round_trip, ids_sha256."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("pii", personal_data_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SQL cannot express the piece lattice; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table.

    What a stage stored on its way, and its input, go once its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            docs = stored(made, name.replace(" ", "-"), keep=True)
        if before is not None:
            drop_stored(before)
        before = docs
        free_shuffles(spark)
    return docs
