"""Small derivations: models and names of runs, inputs of archives, error texts, log excerpts, reply schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import collapse, model_tag, short_model, trim_space, without_annotations


def model_list(c: Column, default: list[str]) -> Column:
    """Models of a comma list, stripped, without blanks; the default if there are none."""
    found = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), trim_space), lambda m: m != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, default)))


def effective_model(backend: Column, model: Column, resolved_file: Column) -> Column:
    """The file that ran, for the backend that resolves one; else the configured model."""
    return F.when(backend == "whisper-cpp", F.coalesce(resolved_file, model)).otherwise(model)


def presented(sources: DataFrame, notes: DataFrame) -> DataFrame:
    """Sources with display name and hint from a table of model notes (model, display, hint), else the model that ran."""
    rows = sources.join(notes, "model", "left")
    return rows.withColumn("display", F.coalesce("display", "effective_model", "model"))


def short_source(sources: DataFrame, models: DataFrame, backends: DataFrame) -> DataFrame:
    """Short names: hosted sources by model (model, short_model), local ones by backend (backend, short_backend)."""
    rows = sources.join(models, "model", "left").join(backends, "backend", "left")
    hosted = F.col("device_kind") == "net"
    name = F.when(hosted, short_model(F.col("model"), F.col("short_model"))).otherwise(F.coalesce("short_backend", "backend"))
    return rows.withColumn("short", name).drop("short_model", "short_backend")


def model_file(model: Column, alias: Column) -> Column:
    """File name of a local model: an alias from a lookup, else its leaf without known prefixes."""
    leaf = F.regexp_replace(F.substring_index(model, "/", -1), "^(?:faster-whisper-|whisper-)", "")
    return F.concat(F.lit("ggml-"), F.coalesce(alias, leaf), F.lit(".bin"))


def archive_runs(runs: DataFrame, archives: DataFrame) -> DataFrame:
    """Runs (run_id, path, transcripts) over archives (archive, audio, transcripts): the audio replaces the input and the
    archive's transcripts follow the explicit ones; the archive still names the run."""
    inside = archives.select(F.col("archive").alias("path"), F.col("audio").alias("_audio"), F.col("transcripts").alias("_own"))
    rows = runs.join(inside, "path", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "run_id", F.coalesce("_audio", "path").alias("input"), F.concat(F.coalesce("transcripts", none), F.coalesce("_own", none)).alias("transcripts"),
        F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("name"),
    )


def export_directory(output: Column) -> Column:
    """Directory of a run's exported sources beside its output."""
    return F.concat(F.regexp_replace(F.regexp_replace(output, r"\.[^./]*$", ""), "-clean$", ""), F.lit("-sources"))


def error_text(c: Column, most: int = 300) -> Column:
    """One line of an error, cut to its length limit as shown to readers."""
    return F.left(collapse(c), F.lit(most))


def log_excerpt(log: Column, markers: list[str], most: int = 6) -> Column:
    """The first lines of a log that hold a marker, on one line."""
    low = lambda line: F.lower(line)
    hit = lambda line: F.exists(F.array(*map(F.lit, markers)), lambda m: low(line).contains(m))
    return F.array_join(F.slice(F.filter(F.transform(F.split(log, "\n"), trim_space), hit), 1, most), " | ")


def case_skeletons(runs: DataFrame, heading: str) -> DataFrame:
    """Cases from exported runs (case, src_idx, label, model, text, clean): numbered files, the clean text without
    annotations and an empty label document. Cases without sources or clean text are left out."""
    n = F.transform(F.array_sort(F.collect_list(F.struct("src_idx", "model", "text"))), lambda s, i: F.struct(F.concat(F.lpad((i + 1).cast("string"), 2, "0"), F.lit("-"), model_tag(s["model"]), F.lit(".txt")).alias("file"), s["text"].alias("text")))
    clean = without_annotations(F.first("clean", ignorenulls=True), heading)
    rows = runs.filter(trim_space(F.coalesce("text", F.lit(""))) != "").groupBy("case").agg(n.alias("sources"), clean.alias("clean"))
    labels = F.to_json(F.struct(F.array().cast("array<string>").alias("expected"), F.array().cast("array<string>").alias("optional"), F.array().cast("array<string>").alias("forbidden")))
    return rows.filter("clean is not null").withColumn("labels", labels)


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """Live text (run_id, seq, text) of each run, chunks in order, blank ones left out."""
    ordered = F.array_sort(F.collect_list(F.when(trim_space(F.col("text")) != "", F.struct("seq", trim_space(F.col("text")).alias("t")))))
    return chunks.groupBy("run_id").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"))


def reply_schema(note_cap: int, alternatives: int = 3, quote_chars: int = 200, context_chars: int = 80, verbatim_chars: int = 300) -> dict:
    """JSON schema of an audit reply whose number of notes is capped by the length of the text."""
    text = lambda n: {"type": "string", "maxLength": n}
    closed = lambda fields: {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}
    reading = closed({"text": text(quote_chars), "source": {"type": "integer", "minimum": 1}, "verbatim": text(verbatim_chars)})
    note = closed(
        {"quote": text(quote_chars), "before": text(context_chars), "after": text(context_chars), "alternatives": {"type": "array", "minItems": 1, "maxItems": alternatives, "items": reading}}
    )
    return closed({"uncertain": {"type": "array", "maxItems": note_cap, "items": note}})
