"""The boundary to recognisers and language models: functions that the caller supplies, run once loaded in each task.

No model is part of the library. ``recorded`` stands in for one with outputs that were kept before.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.numeric import pcm_seconds
from tessella.operators.selection import numbered_labels
from tessella.operators.signals import levelled_recordings

#: Takes audio bytes and a sample rate, gives text; an exception is recorded as the row's error.
Recogniser = Callable[[bytes, int], str]
RESULT = "struct<text:string,error:string,seconds:double>"


def _attempt(load: Callable[[], Recogniser] | None, name: str | None, loaded: dict, pcm: bytes, rate: int) -> tuple[str | None, str | None, float | None]:
    """Text, error and seconds of one recording; its recogniser is loaded before the first."""
    if load is None:
        return None, f"unknown backend {name}", None
    began, text, error = time.monotonic(), None, None
    try:
        if name not in loaded:
            loaded[name] = load()
        text = loaded[name](pcm, rate)
    except Exception as e:  # a failed source never stops the others
        error = str(e) or type(e).__name__
    return text, error, round(time.monotonic() - began, 3)


def recognised(recordings: DataFrame, load: Callable[[], Recogniser]) -> DataFrame:
    """``recordings`` (rec_id, sample_rate, pcm) with text, error and seconds. ``load`` runs once a task, before its first row.

    Tasks may run twice after a lost executor, so a recogniser must not keep state; results are told apart by rec_id.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Recogniser] = {}
        for pcm, rate in batches:
            yield pd.DataFrame([_attempt(load, "", loaded, data, hz) for data, hz in zip(pcm, rate, strict=True)], columns=["text", "error", "seconds"])

    return recordings.withColumn("_r", run("pcm", "sample_rate")).select(*recordings.columns, "_r.text", "_r.error", "_r.seconds")


def recorded(recordings: DataFrame, outputs: DataFrame) -> DataFrame:
    """The same from kept outputs (rec_id, text, error, seconds); a recording without one has an error."""
    rows = recordings.join(outputs, "rec_id", "left")
    return rows.withColumn("error", F.when(F.col("text").isNull(), F.coalesce("error", F.lit("no recorded output"))))


def by_backend(sources: DataFrame, backends: dict[str, Callable[[], Recogniser]]) -> DataFrame:
    """Sources (backend, rec_id, sample_rate, pcm) each recognised by its backend, in one pass; null and unknown backends
    are errors of their rows. A task loads the backends that its rows name."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, Recogniser] = {}
        for names, pcm, rate in batches:
            yield pd.DataFrame([_attempt(backends.get(n), n, loaded, data, hz) for n, data, hz in zip(names, pcm, rate, strict=True)], columns=["text", "error", "seconds"])

    # Rows of one backend come together, so that few tasks load it more than once.
    ordered = sources.sortWithinPartitions("backend")
    return ordered.withColumn("_r", run("backend", "pcm", "sample_rate")).select(*sources.columns, "_r.text", "_r.error", "_r.seconds")


def final_recognition(recordings: DataFrame, sources: DataFrame, backends: dict[str, Callable[[], Recogniser]], prefix: str = "asr") -> DataFrame:
    """Every source (run_id, src_idx, backend) on the recording of its run (run_id, sample_rate, pcm).

    Labels are given by place before anything runs, so a source keeps its number whatever fails. The length (seconds, three decimals) is probed and the
    recording levelled first, each with an error of its own that stops nothing: without a length the run goes on, and a
    recording that can't be levelled is recognised as it came. A source of a run without a recording is an error.
    Rows: run_id, src_idx, label, backend, text, error, seconds, duration, probe_error, level_error.
    """
    own = recordings.select(F.col("run_id").alias("rec_id"), F.col("sample_rate").cast("int").alias("sample_rate"), "pcm")
    probed = own.select(
        F.col("rec_id").alias("run_id"),
        F.when((F.col("sample_rate") > 0) & (F.length("pcm") % 2 == 0), F.bround(pcm_seconds(F.length("pcm"), F.col("sample_rate")), 3)).alias("duration"),
    ).withColumn("probe_error", F.when(F.col("duration").isNull(), "the length can't be told"))
    levelled = levelled_recordings(own).select(F.col("rec_id").alias("run_id"), "sample_rate", "pcm", F.col("error").alias("level_error"))
    heard = levelled.join(probed, "run_id")
    jobs = numbered_labels(sources.select("run_id", "src_idx", "backend"), prefix).join(heard.withColumn("_heard", F.lit(True)), "run_id", "left")
    # A row without a recording meets no backend.
    jobs = jobs.withColumnRenamed("backend", "_backend").withColumn("backend", F.when(F.col("_heard"), F.col("_backend")))
    found = by_backend(jobs, backends)
    error = F.when(F.col("_heard").isNull(), "no recording").when(F.col("_backend").isNull(), "no backend").otherwise(F.col("error"))
    return found.select("run_id", "src_idx", "label", F.col("_backend").alias("backend"), "text", error.alias("error"), "seconds", "duration", "probe_error", "level_error")


def backend_summary(results: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per run the summary (backend, summary) of its first source whose backend has one."""
    rows = results.select("run_id", "src_idx", "backend").join(summaries.filter("summary <> ''"), "backend")
    return rows.groupBy("run_id").agg(F.min_by(F.struct("backend", "summary"), "src_idx").alias("s")).select("run_id", "s.backend", "s.summary")


def transcribe_segments(stream: DataFrame, load: Callable[[], Recogniser], sink: Callable[[DataFrame, int], None]):
    """A streaming writer that recognises each micro-batch of segments and hands it to the sink with its number."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink(recognised(batch, load), n))
