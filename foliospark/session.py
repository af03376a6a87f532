"""Session defaults and engine settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EngineConfig:
    """Limits are parameters, not caps on what a plan may read."""

    rrf_k: int = 60
    max_hits: int = 20
    hits_per_path: int = 2
    max_neighbours: int = 20
    max_chars: int = 60_000
    chunk_chars: int = 3000
    batch_chars: int = 6000
    large_source_chars: int = 60_000
    large_batch_chars: int = 9000
    shard_pages: int = 6
    lease_minutes: int = 30
    max_source_bytes: int = 25 << 20


def builder(app: str = "foliospark") -> SparkSession.Builder:
    """AQE with skew handling, UTC, Arrow; everything else is the cluster's business."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


#: Arrow batches handed to Python hold about this many bytes, however long the texts are.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """The bound on rows alone admits 10 000 texts of any length in one Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
