"""Sinks: single files replaced as a whole, run tables with a latest view and an archive, exported sources."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import wave
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import trim_space
from tessella.operators.naming import export_names


def replace_file(path: str | Path, data: bytes) -> None:
    """Write a local file beside the old one and rename it; a failure leaves the old one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def replace_text(path: str | Path, text: str) -> None:
    replace_file(path, text.encode())


def wav_bytes(pcm: bytes, rate: int) -> bytes:
    """A mono recording of 16 bits as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm)
    return out.getvalue()


def claim(path: str | Path, text: str) -> Path:
    """Write a new local file, never over another: -2, -3, ... up to -999 behind its stem."""
    path = Path(path)
    for n in range(1, 1000):
        own = path if n == 1 else path.with_name(f"{path.stem}-{n}{path.suffix}")
        try:
            with open(own, "x", encoding="utf-8") as f:
                f.write(text)
            return own
        except FileExistsError:
            continue
    raise FileExistsError(f"no free name for {path}")


def accepted(runs: DataFrame) -> DataFrame:
    """Texts that may be written: not empty, without an error."""
    return runs.filter((trim_space(F.coalesce("text", F.lit(""))) != "") & F.col("error").isNull())


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def replace_table(rows: DataFrame, path: str) -> None:
    """Write a table beside the old one and swap their folders; a job or a swap that fails leaves the old one as it is."""
    spark, fresh, old = rows.sparkSession, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    files, target = _files(spark, path)
    fresh, old = _files(spark, fresh)[1], _files(spark, old)[1]
    had = files.exists(target)
    # A store may answer false instead of raising.
    if had and not files.rename(target, old):
        files.delete(fresh, True)
        raise OSError(f"{path} can't be moved")
    try:
        if not files.rename(fresh, target):
            raise OSError(f"{path} can't be put in place")
    except BaseException:
        if had:
            files.rename(old, target)
        files.delete(fresh, True)
        raise
    files.delete(old, True)


def _by_run(rows: DataFrame, key: str):
    """A writer that replaces the folders of the runs it writes and no others."""
    return rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key)


def write_runs(runs: DataFrame, root: str) -> None:
    """Append to the archive, a folder a run, then replace the latest view. Rerunning a run replaces its own folder."""
    _by_run(runs, "run_slug").parquet(f"{root}/archive")
    replace_table(runs, f"{root}/latest")


def write_diagnostics(documents: DataFrame, root: str) -> None:
    """One JSON document (run_id, document) a run, as text; documents of other runs stay."""
    _by_run(documents.select("document", "run_id"), "run_id").text(f"{root}/diagnostics")


def write_sources(sources: DataFrame, root: str) -> None:
    """Exported sources with their file names, a folder a run; exports of other runs stay."""
    _by_run(export_names(sources).select("run_id", "file", "text"), "run_id").json(f"{root}/sources")


def write_export(sources: DataFrame, root: str) -> str:
    """Exported sources in a folder of their own, numbered from the second on: never one that exists. Returns its path."""
    for n in range(1, 1000):
        path = root if n == 1 else f"{root}-{n}"
        files, folder = _files(sources.sparkSession, path)
        if not files.exists(folder):
            write_sources(sources, path)
            return path
    raise FileExistsError(f"no free name for {root}")


def committed(sinks: dict[str, Callable[[], object]]) -> dict[str, str]:
    """Run each sink by itself; the failures by name. One that fails doesn't keep the others from writing, and the run
    counts as failed if any did."""
    failures = {}
    for name, write in sinks.items():
        try:
            write()
        except (OSError, PySparkException, Py4JJavaError) as error:
            failures[name] = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    return failures


def distinct_from_inputs(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Outputs (run_id, path) that aren't also an input (path) of any run: an output never replaces what was read."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:(?://)?(?=/)", ""), r"/(?:\./)*/*", "/")
    return outputs.join(inputs.select(plain(F.col("path")).alias("_input")).distinct(), plain(F.col("path")) == F.col("_input"), "left_anti")


def rejected_candidates(attempts: DataFrame) -> DataFrame:
    """Attempts (model, attempt_idx, content, error) rejected as too short, to be kept word for word."""
    return attempts.filter(F.startswith("error", F.lit("incomplete cleanup:")) & F.contains("error", F.lit("suspiciously short (")))
