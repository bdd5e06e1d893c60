"""Sharding by longest-processing-time scheduling: groups of equal texts go, largest first, to the least-loaded shard.

Scale: a heap over every distinct text would have to live on the driver. Instead every group of at least
``1 / (shards * grain)`` of all bytes is scheduled by itself (there can be at most ``shards * grain`` such groups), and
the smaller groups are first gathered by hash into ``shards * grain`` bundles that are scheduled as one item each. The
heap so sees at most ``2 * shards * grain`` items at any corpus size, and equal texts never part.

Law: ``bytes``. LPT leaves the fullest shard above the mean by no more than the last item placed on it, unless a single group of equal
texts is larger than a shard's share; that group then fills a shard alone, as it must stay together.

Edge cases: a null text has no bytes (size 16), checksum 0, and all null texts form one group apart from empty texts. Null
ids and repeated rows are rows like any other. An empty table gives an empty result. Columns other than the id and the
text are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

#: Parts of a shard in which slots are numbered independently; their counts are then summed up.
SLOT_CHUNKS = 1024


def schedule(items: Iterable[tuple[object, int]], shards: int) -> dict[object, int]:
    """LPT: each item in descending size to the shard with the least load (ties: lowest number)."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[key] = shard
    return placed


def shard_documents(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, grain: int = 64
) -> DataFrame:
    """Give each row its size, checksum, shard and gapless slot within the shard."""
    spark = docs.sparkSession
    text = F.col(text_col)
    sized = settle(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64(text.isNull(), text).alias("group_key"),
        ),
        "shard-sizes",
    ).withColumn("at_row", F.monotonically_increasing_id())
    items = shards * grain
    total = sized.agg(F.sum("size")).first()[0] or 0
    large = -(-total // items) or 1
    groups = (
        sized.groupBy("group_key")
        .agg(F.sum("size").alias("bytes"))
        .withColumn("alone", F.col("bytes") >= large)
        .withColumn("item", F.when(F.col("alone"), F.col("group_key")).otherwise(F.pmod("group_key", F.lit(items))))
        .groupBy("alone", "item")
        .agg(F.sum("bytes").alias("bytes"))
    )
    # At most 2 * items rows: groups that reach the threshold, and the bundles.
    placed = schedule((((r["alone"], r["item"]), r["bytes"]) for r in groups.collect()), shards)

    def listed(alone: bool, *names: str) -> DataFrame:
        """As an Arrow table, for which no executor starts Python workers."""
        rows = [(item, shard) for (a, item), shard in placed.items() if a == alone]
        return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32()))], names=names))

    single, bundled = listed(True, "group_key", "own_shard"), listed(False, "bundle", "bundle_shard")
    dealt = (
        sized.withColumn("bundle", F.pmod("group_key", F.lit(items)))
        .join(F.broadcast(single), "group_key", "left")
        .join(F.broadcast(bundled), "bundle", "left")
        .select(
            "doc_id", "size", "text_crc32", "group_key",
            F.coalesce("own_shard", "bundle_shard").alias("shard"),
            F.pmod(F.xxhash64("doc_id", "group_key", "at_row"), F.lit(SLOT_CHUNKS)).alias("chunk"),
        )
    )
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "chunk")
        .count()
        .select("shard", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "group_key", "size", "text_crc32")
    # The offsets have at most shards * SLOT_CHUNKS rows.
    return (
        dealt.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "chunk"])
        .select(
            "doc_id", "size", "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
