"""Run records: events, outcomes, counters and the diagnostics document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessella.functions.numeric import decibels, realtime_factor
from tessella.functions.text import collapse, strip_timestamps, word_total

SCHEMA_VERSION = 7


def events(log: DataFrame) -> DataFrame:
    """Log rows (run_id, at, type, fields) with their number and seconds since the run's first, three decimals."""
    run = Window.partitionBy("run_id")
    seconds = F.col("at").cast("timestamp").cast("double")
    since = F.bround(seconds - F.min(seconds).over(run), 3)
    return log.withColumn("seq", F.row_number().over(run.orderBy("at", "type", "fields"))).withColumn("t", since)


def transcript_events(sources: DataFrame) -> DataFrame:
    fields = F.to_json(F.struct("label", F.length("text").alias("chars"), word_total(F.col("text")).alias("words")))
    return sources.select("run_id", "src_idx", F.lit("transcript").alias("type"), fields.alias("fields"))


def last_values(named: DataFrame) -> DataFrame:
    """Per run a map of the last value (run_id, name, seq, value) of each name."""
    last = named.groupBy("run_id", "name").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))


def last_few(log: DataFrame, kind: str, n: int) -> DataFrame:
    """Per run the last ``n`` messages (run_id, seq, type, message) of a type, in order."""
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("seq")))
    rows = log.filter(F.col("type") == kind).withColumn("_r", rank).filter(F.col("_r") <= n)
    return rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "message"))), lambda s: s["message"]).alias("messages"))


def status_counts(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.count("*").alias("n"))


def outcomes(results: DataFrame) -> DataFrame:
    """Recognition results (run_id, label, model, text, skip_reason, error, seconds, duration) by exactly one of text, skip, error.

    Text is collapsed, without time marks for models that write them; an empty one is a skip, not an error.
    """
    text = F.when(F.lower("model").contains("parakeet"), strip_timestamps(F.col("text"))).otherwise(collapse(F.col("text")))
    rows = results.withColumn("_text", F.coalesce(text, F.lit("")))
    failed, skipped = F.col("error").isNotNull(), F.col("skip_reason").isNotNull() | (F.col("_text") == "")
    return rows.select(
        "run_id", "label",
        F.when(~failed & ~skipped, F.col("_text")).alias("text"),
        F.when(~failed & skipped, F.coalesce("skip_reason", F.lit("empty text"))).alias("skip_reason"),
        "error", F.bround("seconds", 3).alias("seconds"), realtime_factor(F.col("duration"), F.col("seconds")).alias("realtime_factor"),
        (~failed & ~skipped).alias("ok"),
    )


def collected(outcome_rows: DataFrame, prepared: DataFrame) -> DataFrame:
    """Outcomes joined with their prepared sources; src_idx restores the collection order."""
    return prepared.join(outcome_rows, ["run_id", "label"])


def levels(frames: DataFrame) -> DataFrame:
    """Running maxima over frames (run_id, frame_no, peak, rms) and their levels: the largest frame, not the whole."""
    return frames.groupBy("run_id").agg(F.max("peak").alias("peak"), F.bround(F.max("rms"), 2).alias("rms")).withColumn("peak_db", decibels(F.col("peak")))


def clean_texts(runs: DataFrame, cleanups: DataFrame) -> DataFrame:
    """Every run with its cleaned text (run_id, text), empty without a cleanup."""
    return runs.join(cleanups.select("run_id", F.col("text").alias("clean_text")), "run_id", "left").withColumn("clean_text", F.coalesce("clean_text", F.lit("")))


def run_failed(runs: DataFrame) -> DataFrame:
    """A run fails that was interrupted, has errors or made no output."""
    return runs.withColumn("failed", F.col("interrupted") | (F.col("errors") > 0) | (F.coalesce("output", F.lit("")) == ""))


def diagnostics(runs: DataFrame, sources: DataFrame, outcome_rows: DataFrame) -> DataFrame:
    """The diagnostics document of each run (run_id, started, clean_text) as JSON."""
    of = F.struct("src_idx", "label", "model", "kind", F.length("text").alias("chars"), word_total(F.col("text")).alias("words"))
    heard = sources.groupBy("run_id").agg(F.array_sort(F.collect_list(of)).alias("transcripts"))
    done = outcome_rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("label", "ok", "skip_reason", "error", "seconds", "realtime_factor"))).alias("asr"))
    rows = runs.join(heard, "run_id", "left").join(done, "run_id", "left")
    document = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema"), F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("started"),
        F.length("clean_text").alias("clean_chars"), "transcripts", "asr",
    )
    return rows.select("run_id", F.to_json(document).alias("document"))


def run_slug(started):
    return F.date_format(started, "yyyyMMdd-HHmmss-SSSSSS")


def report_lines(runs: DataFrame) -> DataFrame:
    """Cleanup report of runs (served, requested, checkpoint, marked, audit_note, full_auto), one row a line."""
    model = F.when(F.col("served") == F.col("requested"), F.concat(F.lit("model "), "served")).otherwise(F.concat(F.lit("model "), "served", F.lit(" for "), "requested"))
    lines = F.array(
        model,
        F.when(F.col("checkpoint").isNotNull(), F.concat(F.lit("checkpoint "), "checkpoint")),
        F.when(F.col("marked") > 0, F.format_string("%d passages marked", F.col("marked"))),
        F.when(F.col("full_auto") & F.col("audit_note").isNotNull(), F.col("audit_note")),
    )
    return runs.select("run_id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("line_no", "line"))


def throttled(warnings: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Per stream the warnings (stream_id, t) at least ``seconds`` after the last one shown.

    The next one shown depends on the last, so each stream is read in order, batch by batch with the last one carried over.
    """
    kind = warnings.schema["stream_id"].dataType.simpleString()
    id_type = to_arrow_type(warnings.schema["stream_id"].dataType)

    def run(batches):
        stream, last, began = None, float("-inf"), False
        for b in batches:
            keep = []
            for key, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not began or key != stream:
                    stream, last, began = key, float("-inf"), True
                if t is not None and t - last >= seconds:
                    keep.append((key, t))
                    last = t
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keep], id_type), pa.array([t for _, t in keep], pa.float64())], names=["stream_id", "t"])

    rows = warnings.select("stream_id", F.col("t").cast("double").alias("t")).repartition("stream_id").sortWithinPartitions("stream_id", "t")
    return rows.mapInArrow(run, f"stream_id {kind}, t double")
