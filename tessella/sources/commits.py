"""The commit point of a run: every output staged by itself, put in place, and named by a manifest that is written last.

A run's outputs are tables by name, its diagnostics a JSON document. ``commit_run`` writes each output to a staging folder,
so one that fails neither stops the others nor leaves half of itself where it belongs; then folders are renamed into
``root/<name>/run=<run>``. What was computed but can't be placed moves to a recovery folder, which may lie in another store;
an output that a failing run should keep (its recording) goes there too. The manifest under ``root/_manifests`` tells what is
where and counts: readers see a run once its manifest stands, whole or not at all, and a run that has one isn't written
again. ``replace_recovered`` puts what was recovered in its place when the store takes it again, then writes the manifest anew.

A driver that is lost before the manifest leaves folders that no reader sees and the next attempt replaces.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tessella.sources.sinks import _files

FAULTS = (OSError, PySparkException, Py4JJavaError)
PLACED, RECOVERED, FAILED = "placed", "recovered", "failed"


def _reason(error: BaseException) -> str:
    cause = getattr(error, "java_exception", None)
    said = str(cause.toString() if cause is not None else error).splitlines()
    return f"{type(error).__name__}: {said[0] if said else ''}"


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to a name that is free; a store may answer false instead of raising."""
    files, at = _files(spark, target)
    if files.exists(at) or not (files.mkdirs(at.getParent()) and files.rename(_files(spark, source)[1], at)):
        raise OSError(f"can't move {source} to {target}")


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file with the text, whole or not at all; never over another one."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    files, at = _files(spark, part)
    out = files.create(at, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        _move(spark, part, path)
    except BaseException:
        files.delete(at, False)
        raise


def _read_text(spark: SparkSession, path: str) -> str | None:
    files, at = _files(spark, path)
    if not files.exists(at):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def _clear(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def manifest_of(spark: SparkSession, root: str, run: str) -> dict | None:
    found = _read_text(spark, f"{root}/_manifests/{run}.json")
    return json.loads(found) if found else None


def commit_run(
    spark: SparkSession, root: str, run: str, outputs: Mapping[str, DataFrame], diagnostics: dict, recovery: str | None = None,
    keep_on_failure: Mapping[str, DataFrame] | None = None,
) -> dict:
    """Write the outputs of a run and return its manifest: run, failed, errors, and by name the state, path and error.

    ``diagnostics`` are written with the errors added. ``keep_on_failure`` are written to the recovery folder, but only if the run
    has errors of its own (``diagnostics["errors"]``) or any output fails.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
        raise ValueError(f"not a run's name: {run!r}")
    if (known := manifest_of(spark, root, run)) is not None:
        return known
    attempt = uuid.uuid4().hex[:12]
    staging, rescue = f"{root}/_staging/{run}-{attempt}", f"{recovery or root + '/_recovery'}/{run}-{attempt}"
    states: dict[str, dict] = {}
    errors = list(diagnostics.get("errors", []))

    def fault(name: str, error: BaseException) -> str:
        errors.append(f"could not save {name}: {_reason(error)}")
        return errors[-1]

    def recover(name: str, rows: DataFrame, why: str | None) -> dict:
        try:
            rows.write.parquet(f"{rescue}/{name}")
            return {"state": RECOVERED, "path": f"{rescue}/{name}", "error": why}
        except FAULTS as error:
            return {"state": FAILED, "path": None, "error": fault(f"{name} for recovery", error)}

    for name, rows in outputs.items():
        own, target = f"{staging}/{name}", f"{root}/{name}/run={run}"
        try:
            rows.write.parquet(own)
        except FAULTS as error:
            states[name] = recover(name, rows, fault(name, error))
            continue
        try:
            _clear(spark, target)  # what an attempt without a manifest left
            _move(spark, own, target)
            states[name] = {"state": PLACED, "path": target, "error": None}
        except FAULTS as error:
            states[name] = recover(name, spark.read.schema(rows.schema).parquet(own), fault(name, error))
    if errors or any(s["state"] != PLACED for s in states.values()):
        for name, rows in (keep_on_failure or {}).items():
            states[name] = recover(name, rows, None)
    manifest = {"run": run, "failed": bool(errors), "errors": errors, "outputs": states}
    document = json.dumps(diagnostics | {"errors": errors, "run_failed": bool(errors) or bool(diagnostics.get("run_failed"))}, indent=2)
    places = [f"{root}/diagnostics/{run}.json", f"{rescue}/diagnostics.json"]
    for at, path in enumerate(places):
        try:
            _clear(spark, path)
            _write_text(spark, path, document)
            manifest["diagnostics"] = path
            break
        except FAULTS as error:
            fault("diagnostics", error)
            manifest |= {"failed": True}
            if at + 1 == len(places):
                manifest["diagnostics"] = None
    manifest["failed"] |= bool(diagnostics.get("run_failed"))
    for path in (f"{root}/_manifests/{run}.json", f"{rescue}/manifest.json"):
        try:
            _write_text(spark, path, json.dumps(manifest, indent=2))
            break
        except FAULTS as error:
            fault("manifest", error)
            manifest["failed"] = True
    else:
        raise OSError(f"run {run} can't be committed: {errors[-1]}")
    try:
        _clear(spark, staging)
    except FAULTS:  # no reader sees it
        pass
    return manifest


def committed_runs(spark: SparkSession, root: str) -> list[dict]:
    """The manifests of all committed runs, in order of their names."""
    files, at = _files(spark, f"{root}/_manifests")
    if not files.exists(at):
        return []
    rows = spark.read.text(f"{root}/_manifests/*.json", wholetext=True).collect()  # one row a run
    return sorted((json.loads(r["value"]) for r in rows), key=lambda m: m["run"])


def committed_output(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """What the committed runs have placed under a name, with the column run; None if there is nothing."""
    paths = [m["outputs"][name]["path"] for m in committed_runs(spark, root) if m["outputs"].get(name, {}).get("state") == PLACED]
    return spark.read.option("basePath", f"{root}/{name}").parquet(*paths) if paths else None


def replace_recovered(spark: SparkSession, root: str, run: str) -> dict:
    """Put the recovered outputs of a run where they belong; those that still can't be placed stay recovered."""
    manifest = manifest_of(spark, root, run)
    if manifest is None:
        raise ValueError(f"run {run} isn't committed")
    moved = []
    for name, state in manifest["outputs"].items():
        if state["state"] == RECOVERED and state["error"]:
            own, target = f"{root}/_staging/{run}-{uuid.uuid4().hex[:12]}", f"{root}/{name}/run={run}"
            try:
                spark.read.parquet(state["path"]).write.parquet(own)  # the recovery folder may lie in another store
                _clear(spark, target)
                _move(spark, own, target)
                moved.append(state["path"])
                manifest["outputs"][name] = {"state": PLACED, "path": target, "error": None}
            except FAULTS as error:
                state["error"] = f"could not save {name}: {_reason(error)}"
    if moved:
        path = f"{root}/_manifests/{run}.json"
        _move(spark, path, f"{root}/_staging/{run}-{uuid.uuid4().hex[:12]}.json")
        _write_text(spark, path, json.dumps(manifest, indent=2))
        for folder in moved:
            _clear(spark, folder)
    return manifest
