"""Numbers, sums and maxima along a key's order, in buckets of that order whose totals are carried over.

A window over a whole key is one task, however long the key. Here rows are numbered or summed within (key, bucket), and the
buckets' totals, one row each, are summed up along the key; so a key with a third of all rows spreads over its buckets.
Rows are shuffled once, by a struct of key and bucket, which windows and the join with the totals share (NULL keys are equal in a
struct). Helper columns take names that the rows don't have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def _free(rows: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as keep them apart from the rows' columns."""
    taken, found = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def _carried(rows: DataFrame, at: str, total: Column, upto: Callable[[Column], Column], carry: str) -> DataFrame:
    """Rows (at, carry): what the buckets before each of a key come to."""
    before = Window.partitionBy(f"{at}.key").orderBy(f"{at}.bucket").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(at).agg(total.alias("_total")).select(at, upto(F.col("_total")).over(before).alias(carry))


def numbered(rows: DataFrame, name: str, key: str, bucket: Column, *order: str) -> DataFrame:
    """``rows`` with their number from 0 along ``order`` within ``key``. ``bucket`` must rise with the order."""
    at, own, carry = _free(rows, "_at", "_own", "_carry")
    placed = rows.withColumn(at, F.struct(F.col(key).alias("key"), bucket.alias("bucket")))
    carried = _carried(placed, at, F.count(F.lit(1)), F.sum, carry)
    placed = placed.withColumn(own, F.row_number().over(Window.partitionBy(at).orderBy(*order)) - 1).join(carried, at)
    return placed.withColumn(name, F.col(own) + F.coalesce(F.col(carry), F.lit(0))).drop(at, own, carry)


def running(rows: DataFrame, name: str, value: Column, key: str, at: str, total=F.sum, size: int = BUCKET) -> DataFrame:
    """``rows`` with the running sum (or maximum, with ``total=F.max``) of ``value`` along the whole numbers ``at``."""
    place, what, own, carry = _free(rows, "_at", "_value", "_own", "_carry")
    placed = rows.withColumns({place: F.struct(F.col(key).alias("key"), F.expr(f"{at} div {size}").alias("bucket")), what: value})
    carried = _carried(placed, place, total(what), total, carry)
    within = Window.partitionBy(place).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn(own, total(what).over(within)).join(carried, place)
    both = F.greatest(own, carry) if total is F.max else F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return placed.withColumn(name, both).drop(place, what, own, carry)


def nearby(rows: DataFrame, name: str, value: Column, key: str, at: str, before: int, after: int, size: int = BUCKET) -> DataFrame:
    """``rows`` with ``value``, an aggregate, over the rows from ``before`` places before to ``after`` behind each.

    Rows near the edge of a bucket of the gapless whole numbers ``at`` also go to the bucket beside it.
    """
    (bucket,) = _free(rows, "_bucket")
    first, last = F.greatest(F.expr(f"({at} - {after}) div {size}"), F.lit(0)), F.expr(f"({at} + {before}) div {size}")
    sent = rows.withColumn(bucket, F.explode(F.sequence(first, last)))
    near = Window.partitionBy(key, bucket).orderBy(at).rowsBetween(-before, after)
    return sent.withColumn(name, value.over(near)).filter(F.col(bucket) == F.expr(f"{at} div {size}")).drop(bucket)


def in_runs(rows: DataFrame, key: str, at: str, value: str, name: str, size: int, before: int, after: int, of: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
    """Rows (key, at, name) of a series by an array function of its runs.

    A run is ``size`` consecutive places with ``before`` places more before and ``after`` behind, where they exist; ``of``
    gets its values, how many of them are more before, and the number of its own places, and gives the values for these.
    Places are gapless from 0. Many runs come in one Arrow batch, each bounded by its size.
    """
    # All runs within reach: first * size <= at + before and (first + 1) * size > at - after.
    reach = F.sequence(F.greatest(F.expr(f"({at} - {after}) div {size}"), F.lit(0)), F.expr(f"({at} + {before}) div {size}"))
    sent = rows.select(F.col(key).alias("key"), F.struct(F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("v")).alias("p"), F.explode(reach).alias("run"))
    runs = sent.groupBy("key", "run").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("key", "run", "ps.at", "ps.v")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows_of, places, found = [], [], []
            for i, run in enumerate(b.column("run").to_pylist()):
                at, v = b.column("at")[i].values.to_numpy(), b.column("v")[i].values.to_numpy(zero_copy_only=False)
                start, stop = np.searchsorted(at, (run * size, (run + 1) * size))
                if stop > start:
                    rows_of.append(np.full(stop - start, i))
                    places.append(at[start:stop])
                    found.append(of(v, int(start), int(stop - start)))
            if rows_of:
                columns = [b.column("key").take(pa.array(np.concatenate(rows_of))), pa.array(np.concatenate(places)), pa.array(np.concatenate(found))]
                yield pa.RecordBatch.from_arrays(columns, [key, at_name, name])

    at_name = at
    return runs.mapInArrow(evaluate, f"{key} {rows.schema[key].dataType.simpleString()}, {at} long, {name} double")
