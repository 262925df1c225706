"""Readers for the captured tables (parquet), with explicit projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.parallel import ensure_parallelism

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; an input read as fewer splits than cores (one row group) is spread
    round-robin so per-row work is parallel. Large inputs pass through unchanged."""
    return ensure_parallelism(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
