import random
import struct
import wave
import zipfile

import pytest

from tessella.sources import datasources, readers


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    datasources.register(spark)


def recording(path, samples, rate=8000, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack(f"<{len(samples)}h", *samples))


def joined(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["start"] or 0)):
        name = r["path"].rsplit("/")[-1]
        assert r["error"] or len(found.get(name, [])) == r["start"]
        found.setdefault(name, []).extend(r["samples"] or [])
    return found


def test_wav_ranges(spark, tmp_path):
    rng = random.Random(1)
    want = {"long.wav": [rng.randrange(-32768, 32768) for _ in range(2503)], "one.wav": [7], "none.wav": []}
    for name, samples in want.items():
        recording(tmp_path / name, samples)
    recording(tmp_path / "stereo.wav", [1, 2], channels=2)
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    # A chunk of odd size before the data, and a size of data beyond the file's end as interrupted recorders leave it.
    head = struct.pack("<4sI4s4sIHHIIHH", b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16)
    (tmp_path / "cut.wav").write_bytes(head + struct.pack("<4sI", b"LIST", 3) + b"abc\0" + struct.pack("<4sI", b"data", 1000) + struct.pack("<3h", 1, -2, 3))
    frame = spark.read.format("wav").option("rowsamples", 100).option("partitionsamples", 500).load(str(tmp_path))
    rows = frame.collect()
    assert frame.rdd.getNumPartitions() == 6 + 1 + 1 + 3
    got = joined([r for r in rows if not r["error"]])
    assert got == want | {"cut.wav": [1, -2, 3]}
    assert {r["path"].rsplit("/")[-1]: r["error"] for r in rows if r["error"]} == {"stereo.wav": "not mono of 16 bits", "broken.wav": "not a WAV file"}
    assert {r["sample_rate"] for r in rows if not r["error"]} == {8000} and max(len(r["samples"]) for r in rows if r["samples"]) == 100
    with pytest.raises(Exception, match="absent"):
        spark.read.format("wav").load(str(tmp_path / "absent.wav")).collect()


def test_wav_round_trip_and_exclusive_names(spark, tmp_path):
    out = tmp_path / "out"
    rows = [(f"r{i}.wav", 16000, bytearray(struct.pack("<3h", i, -i, 5))) for i in range(6)]
    frame = spark.createDataFrame(rows, datasources.PCM).repartition(3)
    frame.write.format("wav").option("exclusive", "true").mode("append").save(str(out))
    assert joined(spark.read.format("wav").load(str(out)).collect()) == {f"r{i}.wav": [i, -i, 5] for i in range(6)}
    # One taken name fails the whole write and leaves what was there, and nothing else.
    more = spark.createDataFrame([("a.wav", 16000, bytearray(b"\1\0")), ("r3.wav", 16000, bytearray(b"\2\0")), ("z.wav", 16000, bytearray(b"\3\0"))], datasources.PCM)
    with pytest.raises(Exception):
        more.write.format("wav").option("exclusive", "true").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == sorted(r[0] for r in rows)
    assert joined(spark.read.format("wav").load(str(out / "r3.wav")).collect()) == {"r3.wav": [3, -3, 5]}
    more.write.format("wav").mode("append").save(str(out))
    assert joined(spark.read.format("wav").load(str(out / "r3.wav")).collect()) == {"r3.wav": [2]} and len(list(out.iterdir())) == 8


def test_failed_tasks_leave_nothing(spark, tmp_path):
    out = tmp_path / "out"
    rows = [("good.wav", 8000, bytearray(b"\1\0")), ("../bad.wav", 8000, bytearray(b"\1\0"))]
    with pytest.raises(Exception, match="not a file name"):
        spark.createDataFrame(rows, datasources.PCM).repartition(2).write.format("wav").mode("append").save(str(out))
    assert not list(out.iterdir()) and sorted(p.name for p in tmp_path.iterdir()) == ["out"]


def test_members(spark, tmp_path):
    def archive(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, data in members:
                z.writestr(n, data)

    archive("good.zip", [("s/talk.MP3", b"x" * 50), ("t/z.txt", b"z"), ("./t/a.srt", b"a"), ("folder/", b"")])
    archive("evil.zip", [("ok.wav", b"1"), ("../../out.txt", b"2")])
    archive("empty.zip", [])
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    (tmp_path / "notes.txt").write_text("no archive")
    frame = spark.read.format("members").option("partitionbytes", 40).load(str(tmp_path))
    rows = [r.asDict() | {"archive": r["archive"].rsplit("/")[-1]} for r in frame.collect()]
    good = {r["member"]: bytes(r["content"]) for r in rows if r["archive"] == "good.zip"}
    assert good == {"s/talk.MP3": b"x" * 50, "t/z.txt": b"z", "t/a.srt": b"a"}
    assert frame.rdd.getNumPartitions() == 2 + 1 + 1
    errors = {r["archive"]: r["error"] for r in rows if r["error"]}
    assert errors["evil.zip"] == "a member's path leaves the archive" and set(errors) == {"evil.zip", "broken.zip"}
    assert [r for r in rows if r["archive"] == "evil.zip"] == [{"archive": "evil.zip", "member": None, "size": 0, "content": None, "error": errors["evil.zip"]}]
    found = {r["archive"].rsplit("/")[-1]: r for r in readers.archive_inputs(frame).collect()}
    assert found["good.zip"]["audio"] == "s/talk.MP3" and found["good.zip"]["transcripts"] == ["t/a.srt", "t/z.txt"]
