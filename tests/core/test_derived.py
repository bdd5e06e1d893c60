from pyspark.sql import functions as F

from tessella.functions.text import without_annotations
from tessella.operators import audit, derived
from tessella.sources import readers, recognizers, sinks


def test_columns(spark):
    row = spark.createDataFrame([("a, ,b", "/x/talk-clean.txt", " boom\n at  x", "ok\n ERROR one\nfine\nerror two")], "m string, o string, e string, l string")
    got = row.select(derived.model_list(F.col("m"), ["d"]), derived.model_list(F.lit(" "), ["d"]), derived.export_directory(F.col("o")), derived.error_text(F.col("e"), 6), derived.log_excerpt(F.col("l"), ["error"])).first()
    assert tuple(got) == (["a", "b"], ["d"], "/x/talk-sources", "boom a", "ERROR one | error two")


def test_lookups(spark):
    s = spark.createDataFrame([("web", "lab/m1:free", "net", None), ("whisper-cpp", "org/whisper-x", "gpu", "ggml-x.bin")], "backend string, model string, device_kind string, file string")
    short = derived.short_source(s, spark.createDataFrame([("lab/m2", "two")], "model string, short_model string"), spark.createDataFrame([("whisper-cpp", "whisper")], "backend string, short_backend string"))
    assert {r["backend"]: r["short"] for r in short.collect()} == {"web": "m1", "whisper-cpp": "whisper"}
    ran = s.withColumn("effective_model", derived.effective_model(F.col("backend"), F.col("model"), F.col("file")))
    notes = spark.createDataFrame([("lab/m1:free", "Model One", "good")], "model string, display string, hint string")
    assert {r["backend"]: (r["display"], r["hint"]) for r in derived.presented(ran, notes).collect()} == {"web": ("Model One", "good"), "whisper-cpp": ("ggml-x.bin", None)}
    assert [r[0] for r in s.orderBy("backend").select(derived.model_file(F.col("model"), F.lit(None).cast("string"))).collect()][1] == "ggml-x.bin"


def test_archives_and_chunks(spark):
    runs = spark.createDataFrame([(1, "/d/a.zip", ["x.txt"]), (2, "/d/b.wav", None)], "run_id int, path string, transcripts array<string>")
    archives = spark.createDataFrame([("/d/a.zip", "t/a.wav", ["t/a.srt"])], "archive string, audio string, transcripts array<string>")
    assert [tuple(r) for r in derived.archive_runs(runs, archives).orderBy("run_id").collect()] == [(1, "t/a.wav", ["x.txt", "t/a.srt"], "a"), (2, "/d/b.wav", [], "b")]
    chunks = spark.createDataFrame([(1, 2, "b "), (1, 1, "a"), (1, 3, " ")], "run_id int, seq int, text string")
    assert derived.joined_chunks(chunks).first()["text"] == "a b"


def test_annotations_come_off_again(spark):
    text = "alpha beta [7] gamma"
    notes = [{"quote": "beta", "before": "", "after": "", "alternatives": [{"text": "bet", "source": 1, "verbatim": "bet"}]}]
    out, _, _ = audit.render(text, notes)
    rows = spark.createDataFrame([(out,), (text,)], "t string").select(without_annotations(F.col("t"), audit.HEADING)).collect()
    assert [r[0] for r in rows] == [text, text]
    kind = "case string, src_idx int, label string, model string, text string, clean string"
    found = derived.case_skeletons(spark.createDataFrame([("c", 1, "l", "org/M.1", "x", out), ("c", 2, "l", "n", "y", None), ("d", 1, "l", "n", "y", None)], kind), audit.HEADING).collect()
    assert len(found) == 1 and found[0]["clean"] == text and [s["file"] for s in found[0]["sources"]] == ["01-m-1.txt", "02-n.txt"]


def test_schema_and_audio(spark):
    assert derived.reply_schema(40)["properties"]["uncertain"]["maxItems"] == 40
    wav = sinks.wav_bytes(b"\x01\x00\xfe\xff", 8000)
    assert readers.wav_samples(spark.createDataFrame([("a", bytearray(wav))], "path string, content binary")).first()["samples"] == [1, -2]


def test_boundary(spark):
    def load():
        def run(pcm, rate):
            if not pcm:
                raise ValueError("no audio")
            return f"{len(pcm)}@{rate}"

        return run

    kind = "backend string, rec_id int, sample_rate int, pcm binary"
    rows = spark.createDataFrame([("a", 1, 8000, bytearray(b"xy")), ("a", 2, 8000, bytearray()), ("zz", 3, 8000, bytearray(b"x"))], kind)
    got = {r["rec_id"]: (r["text"], r["error"]) for r in recognizers.by_backend(rows, {"a": load}).collect()}
    assert got == {1: ("2@8000", None), 2: (None, "no audio"), 3: (None, "unknown backend zz")}
    kept = spark.createDataFrame([(1, "t", None, 1.0)], "rec_id int, text string, error string, seconds double")
    assert {r["rec_id"]: (r["text"], r["error"]) for r in recognizers.recorded(rows.select("rec_id"), kept).collect()} == {1: ("t", None), 2: (None, "no recorded output"), 3: (None, "no recorded output")}


def test_backends_in_one_pass(spark):
    """Rows without a backend come back as errors, and a backend is loaded only where rows name it."""
    kind = "backend string, rec_id int, sample_rate int, pcm binary"
    rows = spark.createDataFrame([(b, i, 8000, bytearray(b"x")) for i, b in enumerate(["a", None, "b", "a", "never", "bad"])], kind)

    def failing():
        raise RuntimeError("no model")

    got = {r["rec_id"]: (r["text"], r["error"]) for r in recognizers.by_backend(rows, {"a": lambda: lambda p, r: "A", "b": lambda: lambda p, r: "B", "bad": failing}).collect()}
    assert got == {0: ("A", None), 1: (None, "unknown backend None"), 2: ("B", None), 3: ("A", None), 4: (None, "unknown backend never"), 5: (None, "no model")}


def test_final_recognition(spark):
    """Labels stand before the run; lengths and levelling fail by themselves; the original is heard where levelling fails."""
    import struct

    loud = struct.pack("<4000h", *[(-1) ** i * (100 + i) for i in range(4000)])
    recordings = spark.createDataFrame([(1, 8000, bytearray(loud)), (2, 8000, bytearray(b"xyz")), (3, None, bytearray(b"ab"))], "run_id int, sample_rate int, pcm binary")
    sources = spark.createDataFrame([(1, 5, "len"), (1, 2, "fails"), (2, 0, "len"), (3, 0, "len"), (4, 0, "len"), (1, 9, None)], "run_id int, src_idx int, backend string")

    def load():
        return lambda pcm, rate: f"{len(pcm)} {pcm == loud}"

    def failing():
        raise RuntimeError("no model")

    got = {(r["run_id"], r["label"]): r for r in recognizers.final_recognition(recordings, sources, {"len": load, "fails": failing}).collect()}
    assert set(got) == {(1, "asr1"), (1, "asr2"), (1, "asr3"), (2, "asr1"), (3, "asr1"), (4, "asr1")}
    assert (got[1, "asr1"]["error"], got[1, "asr2"]["text"], got[1, "asr2"]["duration"], got[1, "asr2"]["level_error"]) == ("no model", "8000 False", 0.5, None)
    assert got[1, "asr3"]["error"] == "no backend"
    assert got[2, "asr1"]["text"] == "3 False" and got[2, "asr1"]["probe_error"] and "original kept" in got[2, "asr1"]["level_error"]
    assert got[3, "asr1"]["text"] == "2 False" and got[3, "asr1"]["duration"] is None
    assert got[4, "asr1"]["error"] == "no recording" and got[4, "asr1"]["text"] is None
    named = spark.createDataFrame([("len", "fast"), ("fails", "")], "backend string, summary string")
    assert {r["run_id"]: r["summary"] for r in recognizers.backend_summary(spark.createDataFrame([(1, 2, "fails"), (1, 5, "len"), (2, 0, "x")], "run_id int, src_idx int, backend string"), named).collect()} == {1: "fast"}
