import io
import json
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import readers, sinks


def test_transcripts(spark, tmp_path):
    (tmp_path / "b.srt").write_text("1\n00:01 --> 00:02\nHello\n")
    (tmp_path / "a.txt").write_bytes(b" plain \xff text\n")
    (tmp_path / "c.json").write_text('{"x": 1}')
    (tmp_path / "empty.vtt").write_text("WEBVTT\n\n")
    paths = [str(tmp_path / n) for n in ("b.srt", "a.txt", "empty.vtt", "c.json")]
    rows = readers.transcripts(spark, paths).orderBy("src_idx").collect()
    assert [(r["src_idx"], r["label"], r["text"]) for r in rows] == [(0, "extra:b.srt", "Hello"), (1, "extra:a.txt", "plain � text"), (3, "extra:c.json", '{"x": 1}')]
    with pytest.raises(Exception):
        readers.transcripts(spark, [str(tmp_path / "none.txt")]).collect()
    assert readers.inline(spark, "a || b||").first()["text"] == "a\nb" and readers.inline(spark, " || ").count() == 0


def archive(path, names):
    with zipfile.ZipFile(path, "w") as z:
        for n, size in names:
            z.writestr(n, b"x" * size)


def test_archives_and_directories(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    archive(tmp_path / "in" / "good.zip", [("s/talk.MP3", 5), ("t/z.txt", 1), ("t/a.srt", 1), ("x.bin", 1)])
    archive(tmp_path / "in" / "two.zip", [("a.wav", 5), ("b.wav", 9)])
    archive(tmp_path / "in" / "none.zip", [("a.txt", 5)])
    archive(tmp_path / "in" / "evil.zip", [("ok.wav", 1), ("../../out.txt", 1)])
    (tmp_path / "in" / "broken.zip").write_bytes(b"PK no")
    (tmp_path / "in" / "deep" / "n.wav").write_bytes(b"")
    (tmp_path / "in" / "notes.txt").write_text("x")
    members = readers.archive_members(spark, str(tmp_path / "in" / "*.zip"))
    got = {r["archive"].rsplit("/")[-1]: r for r in readers.archive_inputs(members).collect()}
    assert (got["good.zip"]["audio"], got["good.zip"]["transcripts"], got["good.zip"]["error"]) == ("s/talk.MP3", ["t/a.srt", "t/z.txt"], None)
    assert got["two.zip"]["error"] == "several audio files: b.wav, a.wav" and got["none.zip"]["error"] == "no audio file"
    assert "leaves the archive" in got["evil.zip"]["error"] and got["broken.zip"]["error"]
    listed = [r["path"].rsplit("/")[-1] for r in readers.listing(spark, str(tmp_path / "in")).collect()]
    assert listed == ["broken.zip", "evil.zip", "good.zip", "none.zip", "two.zip"]
    mixed = spark.createDataFrame([(0, "/b"), (1, "/a"), (2, "/b")], "idx int, path string")
    assert [r["path"] for r in readers.batch_inputs(mixed).orderBy("item").collect()] == ["/b", "/a"]
    kinds = spark.createDataFrame([(1, 2, False, "a", b""), (2, 1, True, "a", b""), (3, 1, False, "a.ZIP", b""), (4, 1, False, "a", b"PK\x03\x04.."), (5, 1, False, "a.wav", b"RIFF")], "run_id int, n_paths int, is_dir boolean, path string, head binary")
    assert [r["input_kind"] for r in readers.input_kind(kinds).orderBy("run_id").collect()] == ["batch", "directory", "archive", "archive", "audio"]


def test_settings_and_cases(spark, tmp_path):
    lines = spark.createDataFrame([("# c",), (" A = 'x=1' ",), ("",), ('B="y"',), ("C=z",), ("bad",)], "value string")
    present = spark.createDataFrame([("C",)], "name string")
    assert {r["name"]: r["setting"] for r in readers.settings(lines, present).collect()} == {"A": "x=1", "B": "y"}
    case = tmp_path / "cases" / "one"
    case.mkdir(parents=True)
    for n, text in (("02-beta.txt", "b"), ("01-alpha-x.txt", "a"), ("10-gamma.txt", "c"), ("clean.txt", "no")):
        (case / n).write_text(text)
    (case / "labels.json").write_text(json.dumps({"optional": ["q"]}, indent=1))
    rows = readers.case_sources(spark, str(tmp_path / "cases")).orderBy("src_idx").collect()
    assert [(r["label"], r["model"], r["text"]) for r in rows] == [("asr1", "alpha-x", "a"), ("asr2", "beta", "b"), ("asr3", "gamma", "c")]
    assert readers.case_labels(spark, str(tmp_path / "cases")).first()["case"] == "one"


def test_wav(spark):
    def of(channels, samples):
        b = io.BytesIO()
        with wave.open(b, "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(b"".join(s.to_bytes(2, "little", signed=True) for s in samples))
        return b.getvalue()

    files = spark.createDataFrame([("a", bytearray(of(1, [1, -2, 3]))), ("b", bytearray(of(2, [1, 2]))), ("c", bytearray(b"no"))], "path string, content binary")
    got = {r["path"]: r for r in readers.wav_samples(files).collect()}
    assert got["a"]["samples"] == [1, -2, 3] and got["a"]["sample_rate"] == 8000 and got["b"]["error"] and got["c"]["error"]


def test_sinks(spark, tmp_path):
    sinks.replace_text(tmp_path / "d" / "f.txt", "one")
    sinks.replace_text(tmp_path / "d" / "f.txt", "two")
    assert (tmp_path / "d" / "f.txt").read_text() == "two" and len(list((tmp_path / "d").iterdir())) == 1
    assert sinks.claim(tmp_path / "d" / "f.txt", "x").name == "f-2.txt" and sinks.claim(tmp_path / "d" / "g.txt", "x").name == "g.txt"
    runs = spark.createDataFrame([("r1", "a", None), ("r2", " ", None), ("r3", "b", "bad")], "run_slug string, text string, error string")
    assert [r["run_slug"] for r in sinks.accepted(runs).collect()] == ["r1"]
    root = str(tmp_path / "out")
    sinks.write_runs(runs.filter("run_slug = 'r1'"), root)
    sinks.write_runs(runs.filter("run_slug = 'r2'"), root)
    sinks.write_runs(runs.filter("run_slug = 'r2'"), root)
    assert spark.read.parquet(f"{root}/archive").count() == 2 and spark.read.parquet(f"{root}/latest").count() == 1
    s = spark.createDataFrame([(1, 0, "A b", "t")], "run_id int, src_idx int, label string, text string")
    sinks.write_sources(s, root)
    assert spark.read.json(f"{root}/sources").first()["file"] == "01-a-b.txt"
    sinks.write_diagnostics(spark.createDataFrame([(1, "{}")], "run_id int, document string"), root)
    assert spark.read.text(f"{root}/diagnostics").first()["value"] == "{}"
    attempts = spark.createDataFrame([("incomplete cleanup: suspiciously short (3",), ("incomplete cleanup: x",), (None,)], "error string")
    assert sinks.rejected_candidates(attempts).count() == 1 and F is not None


def test_sinks_keep_earlier_runs(spark, tmp_path):
    root = str(tmp_path / "out")
    for run in ("r1", "r2", "r2"):
        sinks.write_sources(spark.createDataFrame([(run, 0, "live mic", "t")], "run_id string, src_idx int, label string, text string"), root)
        sinks.write_diagnostics(spark.createDataFrame([(run, "{}")], "run_id string, document string"), root)
    assert {r["run_id"] for r in spark.read.json(f"{root}/sources").collect()} == {"r1", "r2"}
    assert sorted(r["run_id"] for r in spark.read.text(f"{root}/diagnostics").collect()) == ["r1", "r2"]


def test_latest_stays_if_its_job_fails(spark, tmp_path):
    root = str(tmp_path / "latest")
    sinks.replace_table(spark.range(3), root)
    broken = spark.range(3).select(F.raise_error(F.lit("broken")).alias("id"))
    failures = sinks.committed({"latest": lambda: sinks.replace_table(broken, root), "other": lambda: sinks.replace_table(spark.range(5), root + "2")})
    assert list(failures) == ["latest"] and spark.read.parquet(root).count() == 3 and spark.read.parquet(root + "2").count() == 5
    sinks.replace_table(spark.range(4), root)
    assert spark.read.parquet(root).count() == 4


def test_exports_and_inputs(spark, tmp_path):
    rows = spark.createDataFrame([("r", 0, "live mic", "t")], "run_id string, src_idx int, label string, text string")
    first, second = sinks.write_export(rows, str(tmp_path / "export")), sinks.write_export(rows, str(tmp_path / "export"))
    assert (first, second) == (str(tmp_path / "export"), str(tmp_path / "export-2"))
    outputs = spark.createDataFrame([(1, "/a/b.txt"), (2, "file:///a/c.txt"), (3, "/a/./d.txt"), (4, "/a/e.txt")], "run_id int, path string")
    inputs = spark.createDataFrame([("/a/c.txt",), ("/a//d.txt",), ("/a/e.txt.bak",)], "path string")
    assert sorted(r["run_id"] for r in sinks.distinct_from_inputs(outputs, inputs).collect()) == [1, 4]
