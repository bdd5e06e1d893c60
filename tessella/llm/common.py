"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import ONE_ROW, WIDE_ROWS, bounded_broadcast, scratch, settle, shared_dir, small_batches

__all__ = ["ONE_ROW", "WIDE_ROWS", "ascii_lower", "bounded_broadcast", "scratch", "settle", "shared_dir", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; all other characters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
