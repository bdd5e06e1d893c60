import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators.records import throttled
from tessella.streaming.live import Line, QueueRules, live_segments, queue_stream, queue_summary, queued, recorded, throttle_stream
from tessella.streaming.segments import Rules
from tests.core.test_streaming import feed

KIND = "stream_id int, frame_no long, at double, service double, failure boolean"


def simulated(rows, capacity, live, fails=None):
    """Outcomes by a clock: events at every time at which something happens, one after the other."""
    waiting, busy, out, pending = [], float("-inf"), {}, [r for r in rows if fails is None or r[1] <= fails]
    for n, at, _ in rows:
        if fails is not None and at > fails:
            out[n] = "refused"
    clock = sorted({at for _, at, _ in pending} | ({fails} if fails is not None else set()))
    services = {n: s for n, _, s in rows}
    blocked = []

    def consume(until, inclusive=True):
        nonlocal busy
        while waiting or blocked:
            while blocked and len(waiting) < capacity:
                waiting.append(blocked.pop(0))
            n, entered = waiting[0]
            start = max(entered, busy)
            if start > until:
                break
            waiting.pop(0)
            out[n] = "read"
            busy = start + services[n]
            for i in range(len(blocked)):
                if len(waiting) >= capacity:
                    break
                waiting.append((blocked.pop(0)[0], start))

    for at in clock:
        consume(at)
        for n, when, _ in pending:
            if when == at:
                if live and len(waiting) >= capacity:
                    out[n] = "dropped"
                elif len(waiting) >= capacity or blocked:
                    blocked.append((n, at))
                else:
                    waiting.append((n, at))
                consume(at)
        if fails is not None and at == fails:
            out |= {n: "kept" for n, _ in waiting} | {n: "refused" for n, _ in blocked}
            return out
    consume(float("inf"))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), min_size=1, max_size=40), st.integers(1, 4), st.booleans(), st.one_of(st.none(), st.integers(0, 60)))
def test_line_against_a_clock(steps, capacity, live, fails):
    at, rows = 0, []
    for n, (gap, service) in enumerate(steps):
        at += gap
        rows.append((n, float(at), float(service)))
    line, got = Line(), []
    for n, when, service, failure in sorted([(*r, False) for r in rows] + ([(None, float(fails), 0.0, True)] if fails is not None else []), key=lambda r: (r[1], r[3], r[0] or 0)):
        got += line.take(QueueRules(capacity, live), n, when, service, failure)
    got += line.read_until(float("inf"))
    assert {g[0]: g[4] for g in got if g[0] is not None} == simulated(rows, capacity, live, None if fails is None else float(fails))
    assert all(g[3] <= capacity for g in got if g[3] is not None)
    if not live and fails is None:
        assert [g[4] for g in got] == ["read"] * len(rows)


def arrivals(seed=4):
    rng = random.Random(seed)
    rows = []
    for s in range(5):
        at = 100.0
        for n in range(60):
            at += rng.random() * 2
            rows.append((s, n, at, rng.random() * 3, False))
        if s % 2:
            rows.append((s, None, 100.0 + 12 * s, None, True))
    return rows


@pytest.mark.parametrize("live", [True, False])
def test_queue_stream_equals_batch(spark, tmp_path, live):
    rows, rules = arrivals(), QueueRules(3, live)
    want = queued(spark.createDataFrame(rows, KIND).repartition(3), rules).collect()
    parts = [[r for r in rows if k <= r[2] < k + 9] for k in range(100, 240, 9)] + [[(99, 0, 10_000.0, 0.0, False)], [(99, 1, 20_000.0, 0.0, False)]]
    stream = feed(spark, tmp_path, [p for p in parts if p], KIND)
    name = f"queue_{live}"
    q = queue_stream(stream, rules).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [tuple(r) for r in spark.table(name).collect() if r["stream_id"] != 99]
    order = lambda rs: sorted(rs, key=repr)
    assert order(got) == order(map(tuple, want))
    outcomes = {r["outcome"] for r in want}
    assert {"read", "kept", "refused", "failure"} | ({"dropped"} if live else set()) == outcomes


def test_summary_and_recording(spark):
    rows = [(1, n, float(n), 10.0, False) for n in range(6)] + [(1, None, 12.0, None, True), (1, 9, 20.0, 1.0, False), (2, 0, 0.0, 1.0, False)]
    frames = spark.createDataFrame(rows, KIND)
    outcomes = queued(frames, QueueRules(2))
    found = {r["stream_id"]: r.asDict() for r in queue_summary(outcomes).collect()}
    assert found[1] == {"stream_id": 1, "frames": 7, "read": 2, "dropped": 3, "kept": 1, "refused": 1, "deepest": 2, "failed": True}
    assert found[2]["failed"] is False and found[2]["read"] == 1
    assert sorted(r["frame_no"] for r in recorded(frames, outcomes).filter("stream_id = 1").collect()) == [0, 1, 2]
    assert sorted(r["frame_no"] for r in recorded(frames, outcomes, segmented=True).filter("stream_id = 1").collect()) == [0, 1]
    assert queued(frames.limit(0)).collect() == []
    with pytest.raises(Exception, match="needs a time"):
        queued(spark.createDataFrame([(1, 0, None, 1.0, False)], KIND)).collect()


def test_throttled_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, 1000 + t) for s in range(3) for t in sorted(rng.random() * 90 for _ in range(60))] + [(1, None)]
    kind = "stream_id int, t double"
    want = sorted(map(tuple, throttled(spark.createDataFrame(rows, kind)).collect()))
    parts = [[r for r in rows if r[1] is not None and k <= r[1] < k + 11] for k in range(1000, 1100, 11)] + [[(1, None)], [(7, 9000.0)], [(1, 9001.0)]]
    q = throttle_stream(feed(spark, tmp_path, [p for p in parts if p], kind)).writeStream.format("memory").queryName("throttle").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("throttle").collect() if r["t"] < 5000) == want
    assert {(1, 9001.0), (7, 9000.0)} <= {tuple(r) for r in spark.table("throttle").collect()}


def test_quiet_streams_are_flushed(spark, tmp_path):
    kind = "stream_id int, frame_no long, voiced boolean, n_bytes int"
    rules = Rules(pre_roll=3, end_silence=3, min_voiced=2, longest=10, frame_bytes=4)
    part = [(1, n, True, 4) for n in range(5)] + [(2, 0, True, 4)]
    q = live_segments(feed(spark, tmp_path, [part], kind), rules, idle_ms=300).writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    end = time.time() + 60
    while time.time() < end and not spark.table("quiet").count():
        time.sleep(0.5)
    q.stop()
    assert [tuple(r) for r in spark.table("quiet").collect()] == [(1, 0, 4, 5, 5)]
