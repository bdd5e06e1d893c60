import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.operators.records import throttled
from tessella.streaming.segments import Rules, State, fold, rechunk_stream, rechunked, segment_statistics, segment_stream, segments, taken_frames

RULES = Rules(pre_roll=3, end_silence=3, min_voiced=2, longest=10, frame_bytes=4)


def run(voices, rules=RULES, end=False, size=4):
    return fold(State(), rules, [(i, bool(v), size) for i, v in enumerate(voices)], end)


@pytest.mark.parametrize(
    "voices,want",
    [
        ([0, 1, 1, 1, 1, 0, 0, 0], [(0, 7, 8, 4)]), ([1] + [0] * 10, []), ([0, 0, 0, 0, 1, 1, 0, 0, 0], [(2, 8, 7, 2)]),
        ([1] * 30, [(0, 9, 10, 10), (10, 19, 10, 10), (20, 29, 10, 10)]), ([1, 0, 1, 0, 1, 0, 0, 0], [(0, 7, 8, 3)]),
    ],
)
def test_rules(voices, want):
    assert run(voices) == want


def test_flush_and_sizes():
    assert run([1] * 4) == [] and run([1] * 4, end=True) == [(0, 3, 4, 4)] and run([1], end=True) == []
    assert run([1] * 30, size=3) == []
    assert Rules.of_times() == Rules(16, 40, 6, 400, 960)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=80))
def test_segments_are_ordered_runs(voices):
    found = run(voices, end=True)
    assert all(a[1] < b[0] for a, b in zip(found, found[1:]))
    assert all(last - first + 1 == n <= 12 and v >= 1 and v == sum(voices[first : last + 1]) for first, last, n, v in found)


def frames(streams):
    return [(s, i, bool(v), 4, False) for s, voices in streams.items() for i, v in enumerate(voices)]


def test_stream_equals_batch(spark, tmp_path):
    streams = {1: [0, 1, 1, 0, 0, 0, 1, 1, 1] * 3, 2: [1] * 25, 3: [0] * 9}
    kind = "stream_id int, frame_no long, voiced boolean, n_bytes int, end boolean"
    rows = frames(streams)
    want = sorted(tuple(r) for r in segments(spark.createDataFrame(rows, kind), RULES).collect())
    assert want == sorted((s, *x) for s, v in streams.items() for x in run(v, end=True))
    for k in range(0, 30, 7):
        part = [r for r in rows if k <= r[1] < k + 7] + [(s, 99, False, 0, True) for s in streams if k == 28]
        if part:
            spark.createDataFrame(part, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    import os
    import shutil
    import time

    os.makedirs(tmp_path / "feed")
    for n, d in enumerate(sorted(os.listdir(tmp_path / "in"))):
        f = next(x for x in os.listdir(tmp_path / "in" / d) if x.startswith("part"))
        shutil.copy(tmp_path / "in" / d / f, tmp_path / "feed" / f"{n}.parquet")
        os.utime(tmp_path / "feed" / f"{n}.parquet", (time.time() - 100 + n,) * 2)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    q = segment_stream(stream, RULES).writeStream.format("memory").queryName("voice").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("voice").collect()) == want


def test_rechunking(spark):
    data = bytes(range(256)) * 2
    cuts = [0, 1, 1, 7, 130, 131, 400, 512]
    rows = [(1, i, bytearray(data[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(2, 0, bytearray(b"xyz"))]
    got = rechunked(spark.createDataFrame(rows, "stream_id int, chunk_no int, data binary"), 50).orderBy("frame_no").collect()
    assert [bytes(r["frame"]) for r in got] == [data[i : i + 50] for i in range(0, 500, 50)] and {r["stream_id"] for r in got} == {1}


def test_throttle(spark):
    rows = spark.createDataFrame([(1, t) for t in (0.0, 1.0, 4.9, 5.0, 9.0, 11.0)] + [(2, 3.0)], "stream_id int, t double")
    assert sorted(tuple(r) for r in throttled(rows).collect()) == [(1, 0.0), (1, 5.0), (1, 11.0), (2, 3.0)]


def test_pre_roll_keeps_frame_numbers():
    """A frame of the wrong size and a missing number don't shift the first frame."""
    assert fold(State(), RULES, [(0, False, 4), (1, False, 4), (2, False, 3), (3, True, 4), (7, True, 4)], True) == [(0, 7, 4, 2)]


def test_statistics_and_dropped_frames(spark):
    found = spark.createDataFrame([(1, 40, 60, 21, 9), (1, 0, 7, 8, 4)], "stream_id int, first_frame long, last_frame long, frames long, voiced long")
    rows = segment_statistics(found).orderBy("segment").collect()
    assert [(r["segment"], r["first_frame"], r["seconds"]) for r in rows] == [(0, 0, 0.24), (1, 40, 0.63)]
    frames_in = spark.createDataFrame([(1, i, q) for i, q in enumerate((0, 1, 2, 3, 1))] + [(2, 0, 0)], "stream_id int, frame_no long, queued int")
    taken, counts = taken_frames(frames_in, 2)
    assert sorted(r["frame_no"] for r in taken.filter("stream_id = 1").collect()) == [0, 1, 4]
    assert {r["stream_id"]: (r["frames"], r["dropped"], r["failed"]) for r in counts.collect()} == {1: (5, 2, True), 2: (1, 0, False)}
    taken, counts = taken_frames(frames_in, 2, live=False)
    assert taken.count() == 6 and counts.filter("failed").count() == 0


def feed(spark, tmp_path, parts, kind):
    import os
    import time

    os.makedirs(tmp_path / "feed")
    for n, part in enumerate(parts):
        path = tmp_path / f"part{n}"
        spark.createDataFrame(part, kind).coalesce(1).write.parquet(str(path))
        f = next(x for x in path.iterdir() if x.name.startswith("part"))
        f.rename(tmp_path / "feed" / f"{n}.parquet")
        os.utime(tmp_path / "feed" / f"{n}.parquet", (time.time() - 100 + n,) * 2)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))


def test_rechunked_stream_carries_the_rest(spark, tmp_path):
    data = bytes(range(256)) * 2
    parts = [[(1, 0, bytearray(data[:7]))], [(1, 2, bytearray(data[130:400])), (1, 1, bytearray(data[7:130])), (2, 0, bytearray(b"xyz"))], [(1, 3, bytearray(data[400:]))]]
    stream = feed(spark, tmp_path, parts, "stream_id int, chunk_no int, data binary")
    q = rechunk_stream(stream, 50).writeStream.format("memory").queryName("rechunked").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("rechunked").orderBy("frame_no").collect()
    assert [(r["stream_id"], r["frame_no"], bytes(r["frame"])) for r in got] == [(1, i, data[50 * i : 50 * i + 50]) for i in range(10)]


def test_late_frames_are_rejected(spark, tmp_path):
    kind = "stream_id int, frame_no long, voiced boolean, n_bytes int, end boolean"
    stream = feed(spark, tmp_path, [[(1, 5, True, 4, False)], [(1, 4, True, 4, False)]], kind)
    q = segment_stream(stream, RULES).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    with pytest.raises(Exception, match="came after"):
        q.processAllAvailable()
    q.stop()
