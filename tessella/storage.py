"""Storage that driver and executors share: what a job needs again is written there and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch within ``small_batches``: the JVM and the Python worker of each task both hold one.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: The same where a row is a block of its own: Spark's Parquet reader too would take 4,096 of them, or a whole row group, at once.
ONE_ROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
#: How files of such rows are written: row groups and pages end by their bytes, not after a hundred rows at the earliest.
WIDE_ROWS = {"parquet.block.size": f"{16 << 20}", "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Folders written by ``settle`` within each open ``scratch``, the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is missing (local mode, as in tests) a temporary folder is chosen once and kept in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settle(df: DataFrame, name: str, keep: bool = False, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on an executor.

    The folder goes when the ``scratch`` around it ends; with ``keep`` when the next one around that does. Without a
    ``scratch`` it stays, since a result may be read from it at any time. ``options`` are of the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options or {}).parquet(path)
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what ``settle`` wrote within, but for what it was told to keep."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _remove(spark, path)


@contextmanager
def small_batches(spark: SparkSession, sizes: dict[str, str] = BATCH) -> Iterator[None]:
    """What is settled within goes to Python in batches of ``sizes``; whole texts by the ten thousand take a worker far more memory."""
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bounded_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``most_rows`` rows; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
