"""Whether the windows of a recognition cover its recording without gap, overlap or loss of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import collapse, trim_space

TOLERANCE, LENGTH_TOLERANCE = 0.002, 0.01


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def adjacency_faults(intervals: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Per recording how many intervals (rec_id, k, start, stop) are empty or don't start where the one before ends."""
    before = F.lag("stop", 1, 0.0).over(Window.partitionBy("rec_id").orderBy("k"))
    good = finite(F.col("start")) & finite(F.col("stop")) & (F.col("stop") > F.col("start")) & (F.abs(F.col("start") - F.col("before")) <= tolerance)
    rows = intervals.withColumn("before", before)
    return rows.groupBy("rec_id").agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("faults"), F.max("stop").alias("end"), F.count("*").alias("intervals"))


def coverage(results: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``results`` (rec_id, text, truncated, audio_seconds, segments) with ``fault``: NULL where the windows are sound.

    Where a column ``duration`` has the known length, the recognised one may differ by ``LENGTH_TOLERANCE`` seconds.
    """
    other = F.abs(F.col("audio_seconds") - F.col("duration")) > LENGTH_TOLERANCE if "duration" in results.columns else F.lit(False)
    ends = F.transform("segments", lambda s: s["end"])
    begins = F.transform("segments", lambda s: s["start"])
    numbers = F.forall("segments", lambda s: finite(s["start"]) & finite(s["end"]) & s["text"].isNotNull())
    widths = F.forall("segments", lambda s: s["end"] > s["start"])
    joins = F.forall(F.zip_with(begins, F.concat(F.array(F.lit(0.0)), ends), lambda a, b: F.coalesce(F.abs(a - b) <= tolerance, a.isNull())), lambda ok: ok)
    closed = F.abs(F.element_at(ends, -1) - F.col("audio_seconds")) <= tolerance
    said = collapse(F.array_join(F.transform("segments", lambda s: s["text"]), " ")) == collapse(F.col("text"))
    some = F.size("segments") > 0
    fault = (
        F.when(F.col("text").isNull() | F.col("truncated").isNull() | F.col("segments").isNull(), "incomplete reply")
        .when(F.col("truncated"), "truncated")
        .when(~finite(F.col("audio_seconds")) | (F.col("audio_seconds") < 0), "bad length")
        .when(other, "other length")
        .when(~some, F.when(collapse(F.col("text")) != "", "text without windows"))
        .when(~numbers, "bad window")
        .when(~widths, "empty window")
        .when(~joins, "gap or overlap")
        .when(~closed, "short end")
        .when(~said, "text differs from windows")
    )
    return results.withColumn("fault", fault)


def assembled(segments: DataFrame) -> DataFrame:
    """Recognised text (rec_id, k, text) per recording: segments stripped, in order, one space between; NULL is empty."""
    ordered = F.array_sort(F.collect_list(F.struct("k", F.trim(F.coalesce("text", F.lit(""))).alias("t"))))
    return segments.groupBy("rec_id").agg(collapse(F.array_join(F.transform(ordered, lambda s: s["t"]), " ")).alias("text"))


def worker_replies(replies: DataFrame) -> DataFrame:
    """Replies of a recogniser's worker process (rec_id, exit_code, stdout, stderr) as the columns that ``coverage`` reads, or
    an error: a failed process by its message, anything but one JSON object by that. Fields of other types are NULL."""
    body = F.try_parse_json("stdout")
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(body, path, "variant")), F.lit(""))
    typed = lambda path, fits, to: F.when(fits(kind(path)), F.try_variant_get(body, path, to))
    number = lambda k: k.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    windows = lambda k: k.startswith("ARRAY") & ~k.rlike("(start|end): (STRING|BOOLEAN)") & ~k.contains("VARIANT")
    said = trim_space(F.coalesce("stderr", F.lit("")))
    error = (
        F.when(F.col("exit_code") != 0, F.when(said != "", said).otherwise(F.concat(F.lit("the worker ended with "), F.col("exit_code").cast("string"))))
        .when(body.isNull(), "the worker's reply is not JSON")
        .when(~F.schema_of_variant(body).startswith("OBJECT"), "the worker's reply is no object")
    )
    return replies.select(
        "rec_id", error.alias("error"),
        F.when(error.isNull(), typed("$.text", lambda k: k == "STRING", "string")).alias("text"),
        F.when(error.isNull(), typed("$.truncated", lambda k: k == "BOOLEAN", "boolean")).alias("truncated"),
        F.when(error.isNull(), typed("$.audio_seconds", number, "double")).alias("audio_seconds"),
        F.when(error.isNull(), typed("$.segments", windows, "array<struct<start:double,end:double,text:string>>")).alias("segments"),
    )
