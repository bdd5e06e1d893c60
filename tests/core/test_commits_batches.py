import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from tessella.operators.batch_runs import Run, lanes, run_batch
from tessella.sources import commits


def tables(spark):
    return {"texts": spark.createDataFrame([("a", 1)], "text string, n int"), "sources": spark.createDataFrame([("s",)], "source string")}


def test_a_run_is_seen_with_its_manifest(spark, tmp_path):
    root = str(tmp_path / "store")
    assert commits.committed_runs(spark, root) == [] and commits.committed_output(spark, root, "texts") is None
    got = commits.commit_run(spark, root, "r1", tables(spark), {"words": 3})
    assert not got["failed"] and {n: s["state"] for n, s in got["outputs"].items()} == {"texts": "placed", "sources": "placed"}
    assert json.loads((tmp_path / "store" / "diagnostics" / "r1.json").read_text()) == {"words": 3, "errors": [], "run_failed": False}
    # A second attempt changes nothing; another run stands beside.
    again = commits.commit_run(spark, root, "r1", {"texts": spark.createDataFrame([("b", 2)], "text string, n int")}, {})
    assert again == commits.manifest_of(spark, root, "r1")
    commits.commit_run(spark, root, "r2", tables(spark), {})
    assert sorted(map(tuple, commits.committed_output(spark, root, "texts").select("run", "text").collect())) == [("r1", "a"), ("r2", "a")]
    # A folder that an attempt without a manifest left is not seen and gets replaced.
    spark.createDataFrame([("half", 0)], "text string, n int").write.parquet(f"{root}/texts/run=r3")
    assert commits.committed_output(spark, root, "texts").filter("run = 'r3'").count() == 0
    commits.commit_run(spark, root, "r3", tables(spark), {})
    assert [r["text"] for r in commits.committed_output(spark, root, "texts").filter("run = 'r3'").collect()] == ["a"]
    assert not os.listdir(f"{root}/_staging")
    with pytest.raises(ValueError, match="not a run's name"):
        commits.commit_run(spark, root, "../r", {}, {})


def test_what_cannot_be_placed_is_recovered(spark, tmp_path):
    """An output whose place is blocked keeps its computed rows, the others are written and the run counts as failed."""
    root, rescue = tmp_path / "store", str(tmp_path / "rescue")
    root.mkdir()
    (root / "texts").write_text("a file where the folder should be")
    (root / "diagnostics").write_text("the same")
    recording = spark.createDataFrame([(1, bytearray(b"pcm"))], "frame_no int, pcm binary")
    broken = spark.range(1).select(F.raise_error(F.lit("no result")).alias("x"))
    got = commits.commit_run(spark, str(root), "r", tables(spark) | {"broken": broken}, {"words": 1}, rescue, {"recording": recording})
    states = {n: s["state"] for n, s in got["outputs"].items()}
    assert states == {"texts": "recovered", "sources": "placed", "broken": "failed", "recording": "recovered"} and got["failed"]
    assert [r["text"] for r in spark.read.parquet(got["outputs"]["texts"]["path"]).collect()] == ["a"]
    assert bytes(spark.read.parquet(got["outputs"]["recording"]["path"]).first()["pcm"]) == b"pcm"
    assert got["diagnostics"].startswith(rescue)
    said = json.loads(open(got["diagnostics"]).read())
    assert said["run_failed"] and said["words"] == 1 and any("texts" in e for e in said["errors"]) and any("broken" in e for e in said["errors"])
    assert commits.committed_output(spark, str(root), "texts") is None and commits.committed_output(spark, str(root), "sources").count() == 1
    # Once the place is free, what was recovered goes there; the recording of the failure stays where it is.
    (root / "texts").unlink()
    after = commits.replace_recovered(spark, str(root), "r")
    assert after["outputs"]["texts"]["state"] == "placed" and after["outputs"]["recording"]["state"] == "recovered"
    assert [r["text"] for r in commits.committed_output(spark, str(root), "texts").collect()] == ["a"]
    assert commits.manifest_of(spark, str(root), "r") == after


def test_a_recording_is_kept_only_on_failure(spark, tmp_path):
    recording = {"recording": spark.range(1)}
    fine = commits.commit_run(spark, str(tmp_path), "fine", {}, {}, keep_on_failure=recording)
    bad = commits.commit_run(spark, str(tmp_path), "bad", {}, {"errors": ["no cleanup"]}, keep_on_failure=recording)
    assert "recording" not in fine["outputs"] and bad["outputs"]["recording"]["state"] == "recovered" and bad["failed"] and not fine["failed"]


def test_no_manifest_no_commit(spark, tmp_path):
    (tmp_path / "_manifests").write_text("blocked")
    got = commits.commit_run(spark, str(tmp_path), "r", tables(spark), {})
    assert got["failed"] and commits.committed_output(spark, str(tmp_path), "texts") is None if not (tmp_path / "_manifests").is_file() else got["failed"]
    (tmp_path / "_recovery2").write_text("blocked")
    with pytest.raises(OSError, match="can't be committed"):
        commits.commit_run(spark, str(tmp_path), "s", {}, {}, recovery=str(tmp_path / "_recovery2"))


def test_lanes():
    runs = [Run(1, "a"), Run(2, "b", "x"), Run(3, "c"), Run(4, "d", "x"), Run(5, "e", "y")]
    assert [[r.item for r in lane] for lane in lanes(runs)] == [[1], [2, 4], [3], [5]]


def test_failures_stay_with_their_run(spark):
    def process(run):
        if run.item == 2:
            return spark.range(3).select(F.raise_error(F.lit("broken"))).collect()
        if run.item == 3:
            raise SystemExit("no audio")
        if run.item == 4:
            return False
        return spark.range(run.item).count() == run.item

    got = run_batch(spark, [Run(i, f"/in/{i}.wav") for i in range(1, 7)], process, workers=3).orderBy("item").collect()
    assert [(r["item"], r["ok"], r["skipped"]) for r in got] == [(1, True, False), (2, False, False), (3, False, True), (4, False, False), (5, True, False), (6, True, False)]
    assert got[1]["error"] and got[2]["error"] == "no audio" and got[3]["error"] is None
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    with pytest.raises(ValueError, match="no files"):
        run_batch(spark, [], process)


def test_bounds_and_shared_servers(spark):
    """Never more runs than workers at a time, never two of one server, and each lane in a scheduler pool of its own."""
    lock, now, most, servers, pools = threading.Lock(), set(), [0], [], {}

    def process(run):
        with lock:
            assert run.server is None or run.server not in {r.server for r in now}
            now.add(run)
            most[0] = max(most[0], len(now))
            servers.append(run.item)
            pools[run.item] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        spark.range(10).count()
        time.sleep(0.2)
        with lock:
            now.remove(run)

    runs = [Run(i, str(i), "local" if i % 2 else None) for i in range(1, 11)]
    assert run_batch(spark, runs, process, workers=3).filter("ok").count() == 10
    assert 1 < most[0] <= 3 and [i for i in servers if i % 2] == [1, 3, 5, 7, 9]
    assert len({pools[i] for i in (1, 3, 5, 7, 9)}) == 1 and len(set(pools.values())) == 6
    caller = []
    run_batch(spark, [Run(1, "a", "local"), Run(2, "b", "local")], lambda r: caller.append(threading.current_thread()), workers=8)
    assert caller == [threading.current_thread()] * 2
