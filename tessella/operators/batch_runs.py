"""A batch of independent runs: jobs from a bounded pool of threads, each isolated from the failures of the others.

Runs that share a server stand in one lane and follow each other; lanes run side by side, up to ``workers``. Each lane's jobs go to a scheduler pool of
their own, so that with fair scheduling a long run doesn't hold up short ones, and each run's jobs to a job group, which
is cancelled if the run fails. The list of runs is what a caller submits and stays on the driver; their data don't.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

OUTCOME = "item int, path string, ok boolean, skipped boolean, error string, seconds double"


@dataclass(frozen=True)
class Run:
    """A run of a batch by its number from 1; ``server`` names what it mustn't use beside another run."""

    item: int
    path: str
    server: str | None = None


@dataclass(frozen=True)
class Outcome:
    item: int
    path: str
    ok: bool
    skipped: bool
    error: str | None
    seconds: float


def lanes(runs: Iterable[Run]) -> list[list[Run]]:
    """Runs that may stand side by side, in order of their first; those of one server follow each other."""
    found: dict[object, list[Run]] = {}
    for run in runs:
        found.setdefault(run.item if run.server is None else ("server", run.server), []).append(run)
    return list(found.values())


def run_batch(spark: SparkSession, runs: list[Run], process: Callable[[Run], bool | None], workers: int = 4) -> DataFrame:
    """Process every run and give its outcome. ``process`` answers False (or raises) if its run failed; SystemExit skips a run,
    which counts as failed."""
    if not runs:
        raise ValueError("no files to process")
    if len({r.item for r in runs}) < len(runs):
        raise ValueError("two runs have one number")
    context = spark.sparkContext

    def one(run: Run) -> Outcome:
        began, error, skipped, ok = time.monotonic(), None, False, False
        group = f"batch-run-{run.item}"
        context.setJobGroup(group, run.path, interruptOnCancel=True)
        try:
            ok = process(run) is not False
        except SystemExit as e:
            skipped, error = True, str(e)
        except Exception as e:  # one run never stops the batch
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        finally:
            if not ok:
                context.cancelJobGroup(group)
            context.setLocalProperty("spark.jobGroup.id", None)
            context.setLocalProperty("spark.job.description", None)
        return Outcome(run.item, run.path, ok, skipped, error, round(time.monotonic() - began, 3))

    def lane(numbered: tuple[int, list[Run]]) -> list[Outcome]:
        before = context.getLocalProperty("spark.scheduler.pool")
        context.setLocalProperty("spark.scheduler.pool", f"batch-lane-{numbered[0]}")
        try:
            return [one(run) for run in numbered[1]]
        finally:
            context.setLocalProperty("spark.scheduler.pool", before)

    side_by_side = list(enumerate(lanes(runs)))
    count = min(len(side_by_side), max(1, workers))
    if count == 1:
        done = [lane(x) for x in side_by_side]
    else:
        with ThreadPoolExecutor(count) as pool:
            # Wrapped one by one: what is wrapped together would share one set of local properties.
            tasks = [pool.submit(inheritable_thread_target(spark)(lane), x) for x in side_by_side]
            done = [t.result() for t in tasks]
    outcomes = sorted((o for found in done for o in found), key=lambda o: o.item)
    return spark.createDataFrame([astuple(o) for o in outcomes], OUTCOME)
