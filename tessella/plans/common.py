"""Reading the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.running import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as runs: a turn is a source, its role the model, its place the kind."""
    kind = F.element_at(F.array(*map(F.lit, ("asr-live", "asr-final", "external", "user"))), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").cast("int").alias("src_idx"),
        F.concat(F.lit("s"), F.col("turn").cast("string")).alias("label"), F.col("role").alias("model"), kind.alias("kind"), "text",
        F.when(F.col("role") == "system", "given").alias("quality_hint"),
    )


#: The same in SQL.
RUN_SOURCES = """
sources as (select conv_id as run_id, turn::int as src_idx, 's' || turn as label, role as model,
    ['asr-live', 'asr-final', 'external', 'user'][(turn % 4 + 1)::int] as kind, text,
    case when role = 'system' then 'given' end as quality_hint from conversations)"""


def user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values of a user in time order as the samples of a recording."""
    placed = numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "i", "user_id", F.to_date("ts"), "ts", "event_id")
    return placed.select(F.col("user_id").alias("rec_id"), F.col("i").cast("long").alias("i"), (F.col("value") * 100).alias("x"))


USER_SAMPLES = """
samples as (select user_id as rec_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value * 100 as x from events)"""
