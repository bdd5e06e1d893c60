"""Readers of transcripts, subtitles, archives, directories, settings, cases and recordings.

Files are read by Spark, so paths may be in any store that it reaches.
"""

from __future__ import annotations

import io
import posixpath
import wave
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import inline_text, subtitle_text, trim_space
from tessella.operators.running import numbered

# File name suffixes.
AUDIO = (".m4a", ".mp3", ".wav", ".ogg", ".opus", ".flac", ".aac", ".webm", ".mp4")
TRANSCRIPTS = (".txt", ".srt", ".vtt", ".json")
HINT = "an external transcript"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r".(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")


def decoded(content: Column) -> Column:
    """UTF-8 with replacement of what isn't, without a byte order mark."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^\\x{FEFF}", "")


def transcripts(spark: SparkSession, paths: list[str], run_id: str = "run") -> DataFrame:
    """External transcripts in argument order, empty ones dropped; a missing file is an error.

    Subtitle files lose their cues; JSON passes through as it is.
    """
    order = spark.createDataFrame(list(enumerate(paths)), "src_idx int, given string")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    name, text = F.substring_index("path", "/", -1), decoded(F.col("content"))
    body = F.when(suffix(F.col("path")).isin(".srt", ".vtt"), subtitle_text(text)).otherwise(trim_space(text))
    rows = files.join(F.broadcast(order), F.endswith("path", F.regexp_replace("given", "^[a-z]+:/+", "")))  # as many rows as arguments
    return rows.select(
        F.lit(run_id).alias("run_id"), "src_idx", F.concat(F.lit("extra:"), name).alias("label"), stem(F.col("path")).alias("model"),
        F.lit("external").alias("kind"), body.alias("text"), F.lit(HINT).alias("quality_hint"),
    ).filter("text <> ''")


def inline(spark: SparkSession, text: str, run_id: str = "run") -> DataFrame:
    row = spark.createDataFrame([(run_id, 0, "user", "user", "user", text)], "run_id string, src_idx int, label string, model string, kind string, text string")
    return row.withColumn("text", inline_text(F.col("text"))).filter("text <> ''")


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """Audio files and archives at the top of a directory by path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory).select("path", "length")
    return files.filter(suffix(F.col("path")).isin(*AUDIO, ".zip")).orderBy("path")


def batch_inputs(entries: DataFrame) -> DataFrame:
    """Of a mixed list (idx, path) each resolved path once, at its first place."""
    first = entries.groupBy("path").agg(F.min("idx").alias("idx")).withColumn("_all", F.lit(0))
    placed = numbered(first, "item", "_all", F.expr("idx div 65536"), "idx", "path").drop("_all")
    return placed.withColumn("item", F.col("item") + 1)


def input_kind(inputs: DataFrame) -> DataFrame:
    """Inputs (run_id, n_paths, is_dir, path, head) by how they are read: batch, directory, archive (by name or content), audio."""
    zipped = (suffix(F.col("path")) == ".zip") | (F.hex(F.substring("head", 1, 4)) == "504B0304")
    return inputs.withColumn("input_kind", F.when(F.col("n_paths") > 1, "batch").when(F.col("is_dir"), "directory").when(zipped, "archive").otherwise("audio"))


MEMBERS = "archive string, member string, size long, content binary, error string"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = [i for i in z.infolist() if not i.is_dir()]
                    flat = [posixpath.normpath(i.filename.replace("\\", "/")) for i in infos]
                    if any(f.startswith(("/", "../")) or f == ".." or f[1:2] == ":" for f in flat):
                        raise ValueError("a member's path leaves the archive")
                    for f, i in zip(flat, infos, strict=True):
                        yield pd.DataFrame([(path, f, i.file_size, z.read(i), None)], columns=["archive", "member", "size", "content", "error"])
            except (ValueError, zipfile.BadZipFile) as e:
                yield pd.DataFrame([(path, None, 0, None, str(e))], columns=["archive", "member", "size", "content", "error"])


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of zip files; an archive with a path out of it gives one row with an error and nothing else."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members, MEMBERS)


def archive_inputs(members: DataFrame) -> DataFrame:
    """Per archive its one audio file and its transcripts by path; none or several audio files are an error that names up to 8."""
    sized = F.struct((-F.col("size")).alias("s"), F.col("member").alias("m"))
    audio, text = suffix(F.col("member")).isin(*AUDIO), suffix(F.col("member")).isin(*TRANSCRIPTS)
    rows = members.groupBy("archive").agg(
        F.transform(F.array_sort(F.collect_list(F.when(audio, sized))), lambda x: x["m"]).alias("audio"),
        F.array_sort(F.collect_list(F.when(text, F.col("member")))).alias("transcripts"),
        F.max("error").alias("broken"),
    )
    error = F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.size("audio") == 0, "no audio file").when(
        F.size("audio") > 1, F.concat(F.lit("several audio files: "), F.array_join(F.slice("audio", 1, 8), ", "))
    )
    return rows.select("archive", F.when(error.isNull(), F.col("audio")[0]).alias("audio"), "transcripts", error.alias("error"))


def config_lines(lines: DataFrame) -> DataFrame:
    """Lines (value) that are neither blank nor comments, stripped."""
    return lines.select(trim_space(F.col("value")).alias("value")).filter("value <> '' and not startswith(value, '#')")


def settings(lines: DataFrame, present: DataFrame) -> DataFrame:
    """KEY=VALUE lines without quotes around values; keys that are ``present`` (name) already stay as they are."""
    at = F.instr("value", "=")
    pairs = config_lines(lines).filter(at > 1).select(
        trim_space(F.expr("left(value, instr(value, '=') - 1)")).alias("name"),
        F.regexp_replace(trim_space(F.expr("substring(value, instr(value, '=') + 1)")), r"""^(['"])(.*)\1$""", "$2").alias("setting"),
    )
    return pairs.join(present.select("name"), "name", "left_anti")


def case_sources(spark: SparkSession, root: str) -> DataFrame:
    """Numbered sources ``NN-model.txt`` of each case directory, in name order."""
    files = spark.read.text(f"{root}/*/[0-9]*-*.txt", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("case"), stem(F.col("path")).alias("name"), "text")
    model = F.expr("substring(name, instr(name, '-') + 1)")
    rows = rows.withColumn("src_idx", F.row_number().over(Window.partitionBy("case").orderBy("name")))
    return rows.select("case", "src_idx", F.concat(F.lit("asr"), F.col("src_idx").cast("string")).alias("label"), model.alias("model"), "text")


def case_labels(spark: SparkSession, root: str, name: str = "labels.json", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    rows = (reader.schema(schema) if schema else reader).json(f"{root}/*/{name}")
    return rows.withColumn("case", F.element_at(F.split(F.input_file_name(), "/"), -2))


SAMPLES = "struct<sample_rate:int,samples:array<smallint>,seconds:double,error:string>"


def wav_samples(files: DataFrame) -> DataFrame:
    """WAV contents (path, content) as samples; anything but mono of 16 bits is an error."""

    @F.pandas_udf(SAMPLES)
    def run(content: pd.Series) -> pd.DataFrame:
        import numpy as np

        rows = []
        for b in content:
            try:
                with wave.open(io.BytesIO(b)) as w:
                    if (w.getnchannels(), w.getsampwidth()) != (1, 2):
                        raise ValueError("not mono of 16 bits")
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2")
                    rows.append((w.getframerate(), x, len(x) / w.getframerate(), None))
            except (ValueError, EOFError, wave.Error) as e:
                rows.append((None, None, None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["sample_rate", "samples", "seconds", "error"])

    return files.withColumn("_w", run("content")).select("path", "_w.*")


